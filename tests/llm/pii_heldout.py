"""Sentences written by hand to measure the recogniser on what it was not trained on: none shares a frame with the labelled table.

``[person|Maria Lopez]`` marks an entity.
"""

from __future__ import annotations

import re

SENTENCES = """
The keynote at this year's gardening fair will be held by [person|Maria Lopez], who grows orchids.
Yesterday evening [person|Anna Kowalska] phoned the landlord because the heating had gone off again.
We later learned that [person|Thomas Okonkwo] had already sold his bicycle.
For the second time, the jury awarded the medal to [person|Yuki Tanaka].
My grandmother's doctor, [person|Helena Brandt], retired after forty years of practice.
It was [person|Samuel Whitfield] who first proposed moving the archive to the basement.
In his will, [person|Gregory P. Lund] left the cottage to the parish.
A plaque on the wall honours [person|Ludwig van Hoven] and his quartet.
The committee unanimously elected [person|Ursula von der Heide] as treasurer.
Neither [person|Kevin Doyle] nor [person|Rachel Adeyemi] could remember the door code.
[person|Oksana Hrytsenko] swam the channel in under twelve hours.
When the lights came back, [person|Peter J. Marsh] was nowhere to be seen.
Last seen wearing a red coat, [person|Beatrice Fairchild] is being sought by her family.
Guest speaker tonight: [person|Nguyen Van Thanh].
The novel's translator, [person|Ines Carvalho], added a glossary.
Tickets are under the name [person|DELACROIX Hugo].
Ring the bell marked [person|Novotny, Jana] and wait.
Nobody doubted the testimony of [person|R. Castellanos].
The goalkeeper [person|Arnaud Lemoine] saved two penalties.
Minutes taken by [person|Fiona McAllister], distributed the same day.
This cake recipe came down from [person|Ottilie Bergmann] through three generations.
Police officer [person|Dario Fontana] stopped traffic for the ducks.
They named the comet after its discoverer [person|Leif Halvorsen].
Our new neighbour is called [person|Priya Raman] and plays the cello.
Your booking was made by [person|M. Abernathy] on the hotel's website.
The violin belongs to [person|Clara Weiss-Romero].
Is [person|Joanna Pike] still the caretaker of the sports hall?
After the storm [person|Tobias Engel] repaired the roof free of charge.
Mention the code word to [person|Salvatore Greco] at the bar.
Class 4b will be taught by [person|Emily Hartwell] until Easter.
Das Klavier gehörte früher [person|Johanna Steinfeld].
Am Wochenende gewann [person|Klaus Meierhofer] das Schachturnier.
Zur neuen Bürgermeisterin wurde [person|Petra Lindemann] gewählt.
Der Schlüssel liegt bei [person|Walter Gutenbrunner] im Erdgeschoss.
Leider ist [person|Emilia Hofstätter] seit gestern krank.
Als Trainer verpflichtete der Klub [person|Sven Oldenburg].
Das Rezept verdanken wir [person|Gisela Trautmann].
Im Garten von [person|Karl-Heinz Ebert] blühen die Rosen.
Den Nachruf verfasste [person|Ludger Pohlmann] mit viel Gefühl.
Die Geige spielte [person|Annegret Kuhlmann] ganz wunderbar.
Sein Großvater [person|August Wilhelm Rademacher] war Schmied.
Für die Kasse ist künftig [person|F. Zimmermann] zuständig.
Hat jemand [person|Marlene Degenhardt] gesehen?
Auf dem Schild stand [person|BRUCKNER Elisabeth].
Le piano appartenait autrefois à [person|Jeanne Delaunay].
Hier soir, [person|Antoine Mercadier] a gagné le tournoi d'échecs.
La clé se trouve chez [person|Solange Thibault] au rez-de-chaussée.
Ma voisine [person|Brigitte Carpentier] jardine tous les matins.
Le nouveau maire s'appelle [person|Mathieu Desrosiers].
Cette recette nous vient de [person|Odile Garnier].
L'arbitre [person|Rachid Benali] a sifflé trois fois.
On attend encore [person|P. Vasseur] pour commencer.
Le violon est joué par [person|Clémence Aubry].
Son grand-père, [person|Émile Rochefort], était forgeron.
El piano era antes de [person|Josefina Aranda].
Anoche [person|Ramiro Quintero] ganó el torneo de ajedrez.
La llave la tiene [person|Consuelo Barrios] en la planta baja.
Mi vecina [person|Remedios Salcedo] riega las plantas cada mañana.
El nuevo alcalde se llama [person|Gonzalo Ibarra].
La receta nos la dio [person|Milagros Pardo].
El árbitro [person|Óscar Villalobos] pitó tres veces.
Falta por llegar [person|T. Echeverría].
El violín lo toca [person|Noelia Crespo] de maravilla.
Su abuelo, [person|Eusebio Lozano], era herrero.
If nobody picks up, try [phone|555-123-4567] after lunch.
The plumber left a card with [phone|(212) 555-0187] on it.
For urgent repairs there is also [phone|+44 20 7946 0958].
Lost dog! Whoever finds her may ring [phone|0171 555 0143], day or night.
You will find our number, [phone|+1 415 555 0132], on the back of the ticket.
Since the move, grandma can only be reached at [phone|030 5550 1234].
He scribbled [phone|202.555.0119] on a napkin.
Reservations are taken on [phone|+353 1 555 0199] from ten onwards.
The taxi company's [phone|01632 960 457] is always engaged.
Bei Störungen wählen Sie [phone|0800 555 0123].
Der Hausmeister ist unter [phone|+49 89 5550 4321] zu sprechen.
Notieren Sie sich bitte die [phone|0711/5550-98] für Notfälle.
Oma hat jetzt ein Telefon: [phone|04131 555077].
Unsere Praxis hat die neue Nummer [phone|(040) 55501234].
Das Faxgerät läuft auf [phone|+41 44 555 01 23].
En cas de fuite, composez le [phone|01 55 50 12 34].
Le plombier répond au [phone|06 12 55 50 78] jusqu'à vingt heures.
Notre cabinet a changé de numéro : [phone|+33 4 55 50 98 76].
Pour un taxi, faites le [phone|04.55.50.11.22].
Retenez bien le [phone|+32 2 555 01 47].
En caso de fuga, marque el [phone|915 550 123].
El fontanero atiende en el [phone|655 501 987] hasta las ocho.
Nuestra consulta tiene otro número: [phone|+34 93 555 01 76].
Para un taxi, [phone|952 55 50 44].
Apunte el [phone|+52 55 5550 1789] por si acaso.
The answering machine says [phone|1-800-555-0100] but nobody listens to it.
Her pager, [phone|+61 2 5550 1834], went off in the cinema.
Emergency contact of the climber: [phone|+43 512 555 0167]
Call me maybe: [phone|+1 (503) 555-0172]!
Our switchboard ([phone|0131 496 0855]) closes early on Fridays.
At the border she handed over her passport, [id_number|C01X00T47], without a word.
The form asks for the social security number, in my case [id_number|078-05-1120].
Please copy the number of your identity card ([id_number|L01X00T471]) into box three.
His national insurance number, [id_number|QQ 12 34 56 C], was misspelt on the payslip.
The stolen passport [id_number|GB1234567] has been cancelled.
We could identify him by identity card [id_number|AX-4471-9035-12].
Travellers with passport [id_number|533380006] should go to desk two.
To open the account they noted her SSN as [id_number|219-09-9999].
The clerk compared the face with the passport and wrote down [id_number|X7120934].
An der Grenze gab sie ihren Reisepass mit der Nummer [id_number|C4VK8J291] ab.
Im Formular fehlte seine Sozialversicherungsnummer, nämlich [id_number|12 150865 M 003].
Der Mieter hat sich mit Personalausweis [id_number|T220001293] ausgewiesen.
Gestohlen wurde auch der Ausweis Nummer [id_number|LZ6311T47].
Die Rentnerin nannte als Sozialversicherungsnummer [id_number|65 170839 J 008].
À la frontière, elle a tendu son passeport numéro [id_number|09AE12345].
Le formulaire demande le numéro de sécurité sociale, soit [id_number|2 69 05 49 588 157 80].
Le locataire s'est identifié avec la carte d'identité [id_number|880692310285].
On a volé aussi le passeport [id_number|12CV56789] et un parapluie.
L'assuré donne son numéro de sécurité sociale [id_number|1 85 07 75 116 042] au guichet.
En la frontera entregó su pasaporte número [id_number|PAB123456] sin decir nada.
El formulario pide el DNI, en mi caso [id_number|12345678Z].
El inquilino se identificó con el documento de identidad [id_number|X1234567L].
También robaron el pasaporte [id_number|XDA567890] y un paraguas.
La jubilada dio su número de la seguridad social, [id_number|28 12345678 40].
Con el NIE [id_number|Y7654321G] ya puede firmar.
The visa sticker sits in passport [id_number|AB9876543], page four.
They asked the nurse for her identity card number and she read out [id_number|DK-1177-2040-55].
Without social security number [id_number|457 55 5462] no salary can be paid.
La carte nationale d'identité [id_number|BX 1234567] expire bientôt.
Mi número de pasaporte, [id_number|AAC456123], está mal impreso.
If you want the knitting pattern, drop a line to [email|wool.lover82@yarnbarn.com].
The choir's inbox is [email|sing@chorus-leeds.org.uk] and it is full.
She signs all her posts with [email|night_owl@feathers.net].
Unsubscribe at any time by messaging [email|stop@newsletters.io].
All invoices go straight to [email|accounts+2024@brightwell.com].
My cousin's mail, [email|pat.o.malley@greenisle.ie], keeps bouncing.
Forward this to [email|j.doe(at)cityhall.gov] before it is too late.
Spell it out: [email|bob at example dot com].
You'll get the key from [email|frontdesk @ seaviewhotel.com].
Der Chor freut sich über Post an [email|singkreis@musik-ulm.de].
Wer das Strickmuster will, meldet sich bei [email|wollmaus77@garnkiste.de].
Die Rechnung bitte nur noch an [email|buchhaltung@holzbau-kern.at] schicken.
Abmelden können Sie sich über [email|abmelden(at)rundbrief.info].
Meine Tante hat jetzt [email|h.winter@posteo.example].
Pour le patron du tricot, un mot à [email|laine.douce@pelote.fr] suffit.
La chorale lit ses messages sur [email|contact@voix-du-lac.ch].
Les factures partent chez [email|compta@menuiserie-blin.fr].
Pour ne plus rien recevoir : [email|stop@lettre-hebdo.fr].
Mon oncle a perdu l'accès à [email|g.petitjean@courriel.example].
Para el patrón de punto basta un mensaje a [email|ovillo@lanas-vega.es].
El coro recibe cartas en [email|voces@corodelmar.org].
Las facturas van siempre a [email|pagos@carpinteria-rios.es].
Para darse de baja: [email|bajas@boletin.example].
Mi tío usa todavía [email|r_montes1955@correo.mx].
HEADLINE NEWS: TIPS TO [email|TIPS@DAILYHERALD.COM] ONLY.
Ping [email|dev-team@build.local.example] when the server hangs.
Both [email|amy@labs.edu] and [email|raj@labs.edu] were copied in.
Report lost property ([email|lost@trainline.example]) within a week.
The hacker used [email|root＠shadow.example] as a cover.
Nachzügler erreichen mich per [email|nils [at] segelclub [dot] de].
The removal van stopped in front of [address|48 Juniper Lane, Harrogate HG1 5QT].
Grandpa's workshop used to be at [address|7 Foundry Street].
Pizza for [address|1509 Willow Avenue, Apt 3C, Columbus, OH 43215], please hurry.
They spray-painted the garage door of [address|22 Cathedral Close, Wells].
The estate comprises [address|91 Orchard Road, Bath BA1 2LR] and a meadow.
Meet me outside [address|350 Fifth Avenue, New York, NY 10118] at nine.
Our dentist moved from the mall to [address|16b Tanners Row, Kendal].
Fire engines raced towards [address|204 Beechwood Drive].
The café on the corner, [address|5 Market Square, Ludlow SY8 1AA], serves soup.
Sie zog im Herbst in den [address|Fliederweg 7, 39112 Magdeburg].
Die Bäckerei in der [address|Hauptstraße 12] hat sonntags geöffnet.
Pakete nimmt die Nachbarin im [address|Amselsteig 3, 14163 Berlin] an.
Der Unfall geschah vor dem Haus [address|Am Stadtgraben 27, 48143 Münster].
Zur Besichtigung treffen wir uns [address|Kastanienallee 88, 10435 Berlin].
Das Museum findet man unter [address|Neue Gasse 14a, 90403 Nürnberg].
Unser Verein tagt in der [address|Friedrich-Ebert-Str. 5, 34117 Kassel].
Elle vient d'emménager au [address|12 rue de la Paix, 75002 Paris].
La boulangerie du [address|8 avenue des Tilleuls] ouvre le dimanche.
Les colis sont gardés par le voisin du [address|31 bis, rue du Faubourg, 35000 Rennes].
L'accident a eu lieu devant le [address|4 place du Vieux Marché, 76000 Rouen].
Le musée occupe le [address|17, quai des Brumes, 29200 Brest].
Rendez-vous au [address|250 boulevard Lafayette, Marseille].
Notre club se réunit [address|3 impasse des Acacias, 31400 Toulouse].
Acaba de mudarse a la [address|Calle Mayor 5, 28013 Madrid].
La panadería de la [address|Avenida de los Pinos, 14] abre los domingos.
Los paquetes los recoge el vecino de [address|Calle Luna 9, 2.º B, 41001 Sevilla].
El accidente ocurrió frente a [address|Plaza del Trigo n.º 3, Cuenca].
El museo ocupa el [address|Paseo Marítimo 120, 08003 Barcelona].
Quedamos en [address|Camino de Ronda 77, 18004 Granada].
Nuestro club se reúne en [address|C/ Jabonería 21, 30001 Murcia].
On Tuesday the Lakeside Cinema shows Gone With The Wind for the last time.
Robert Bosch GmbH has opened a new plant near Stuttgart.
The Stirling engine was invented long before the Otto cycle.
Batch 078-05-1120 of the jam was recalled because of broken glass.
The library closes on Christmas Eve and on New Year's Day.
You need two eggs, 250 g of flour and 1 litre of milk.
Between 1914 and 1918 the mill stood empty.
The Bay of Biscay is rough in November.
Section 12 of the bylaws was repealed in 2003.
The parcel with tracking number 1Z999AA10123456784 is delayed.
Please quote reference AB1234567 in all letters about the lawnmower.
The Mayor of Casterbridge is on the reading list.
Terminal 5 is served by the Piccadilly Line.
Johnson & Partners LLP moved its office again.
He bought a Stradivarius for 1,200,000 dollars.
Der Zug nach Bad Oldesloe fährt von Gleis 7.
Die Neue Zürcher Zeitung berichtete am 5. Mai 2019 darüber.
Das Los 4711-0815 gewann einen Kühlschrank.
Die Siemens AG baut in Görlitz Turbinen.
Am Tag der Deutschen Einheit bleibt das Rathaus zu.
Im Herbst 1989 fielen die Preise um 12 Prozent.
Aktenzeichen 12 O 345/18 betrifft einen Zaun.
Le Tour de France passe par le Mont Ventoux.
La société Michelin SA produit des pneus à Clermont-Ferrand.
Le colis numéro 6A 123 456 789 a été égaré.
La loi du 5 juillet 1985 protège les piétons.
Il a payé 1 250 000 euros pour un Picasso.
La Vuelta a España termina en Santiago de Compostela.
El lote 915-55-0123 de aceitunas fue retirado.
La empresa Talgo SA fabrica trenes en Vitoria.
El Camino de Santiago tiene 780 kilómetros.
La ley 7/1985 regula los municipios.
Invoice 2023-10-4455 covers the new curtains.
The recipe comes from Great Aunt Agatha's cookbook.
Figure 3 compares Newton rings with Moire fringes.
The Black Forest Gateau won first prize at Bristol.
Call number QA76.73 is on the third shelf.
The ISBN of the paperback is 978-3-16-148410-0.
Version 10.4.11.2 fixes the printer problem.
Dial M for Murder was filmed in 1954.
"""


def sentences() -> list[tuple[str, set[tuple[str, str]]]]:
    """(text, entities) of each sentence."""
    out = []
    marked = re.compile(r"\[(email|phone|id_number|address|person)\|((?:[^\[\]]|\[\w+\])*)\]")
    for line in SENTENCES.strip().split("\n"):
        out.append((marked.sub(r"\2", line), {(m[1], m[2]) for m in marked.finditer(line)}))
    return out
