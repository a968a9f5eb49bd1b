"""The small labelled table the recogniser is trained from: sentence frames with marked slots, and how the slots are filled.

``{a|b}`` is one of its parts, ``{person}`` an entity of that type, ``<cap>`` something that is filled but is nothing personal. The frames are of
letters, forms, reports, news and technical texts in English, German, French and Spanish. Names, towns and streets are partly common ones, partly made of
syllables, so that the field learns forms and contexts rather than a list. ``DECOYS`` look personal and aren't.
"""

from __future__ import annotations

import random
import re

TYPES = ("email", "phone", "id_number", "address", "person")

FRAMES = {
    "person": """
{The report|This memo|The draft|The survey|A first version|The appendix} was {written|prepared|compiled|revised|checked} by {person} {in June|in early spring|in <year>|last week}.
As {person} {explained|pointed out|remarked|put it|has shown}, {it failed|the seal leaked|nothing had moved|the budget was too small}.
{person} {said|noted|argued|found|wrote|claimed|replied|saw|measured|was the first to see} that {the results were sound|the pump ran dry|more time was needed|prices would rise}.
{person} {joined|left|visited|runs|founded} {the team|the plant|our laboratory|the choir} in <year>.
{person} {took part in the audit|gave a talk|lost the key|watched the needle during the run|repaired the gauge by hand}.
{My name is|I am|This is|Here speaks} {person}{.| and I work in the archive.| from accounting.}
{We|I} {thank|would like to thank|spoke with|met|asked|called|owe this hint to|heard from} {person} {for the helpful comments|about the delay|yesterday|last week|and others}.
{Please|Kindly} {contact|ask|inform|notify|write to|see} {person} {if anything is unclear|before Friday|at the front desk|in room <n>}.
{Dear|Hello|Hi|Good morning} {person},
{Yours sincerely|Best regards|Kind regards|With thanks|Regards|Respectfully},{\\n| }{person}
{Mr.|Ms.|Mrs.|Dr.|Prof.|Mr|Ms|Dr|Sir|Miss} {person} {opened the meeting|was not available|will take over|presented the figures|agreed}{.|}
{Author|Creator|Contact|Prepared by|Reviewed by|Approved by|Project lead|Editor|Witness|Filed by|Patient|Tenant|Employee|Customer|Name|Photo|Agent|Designer|Operator|Inventors|Inventor|Attorney}{:|:|: Ms.|: Mr.|: Dr.| -} {person}{|.}
{signed by|signed|sgd.|Signed:|Countersigned|Witnessed by|Signed|Signed,} {person}
The {chair|manager|director|engineer|lawyer|clerk|applicant}, {person}, {did not attend|has resigned|disagreed|signed the form}.
{person} and {person} {share the prize|built the rig|were absent|filed the claim}.
{According to|In the words of|In the opinion of|On behalf of|Together with} {person}, {the matter is closed|the test was stopped|no fee is due}.
{an interview with|a letter from|the statement of|an invoice for|the signature of|a note of|a message from|the mandate for} {person} {is attached|of 2 May <year>|dated <n> August <year>|was received}
<w> <w> {person} <w> <w>{.|}
{<w>|<Comp>|with|von|chez|con|to|by|bei|für|pour|para} {person} {<w>|im|au|en|at|in} {<w>|<Comp>}{.|}
{<W>|The|Der|Die|Le|La|El} {<w>|<Comp>} {<w>|ist|was|fut|es} {person}{,|.| <w>.}
{Both|Only|Even|Either|Not even|Like|Unlike} {person} {and|or|nor|but not} {person} {knew it|came|had a key|were asked}.
{The|Our|A} {singer|nurse|baker|pilot|poet|guard|cook|driver|striker|painter|author} {person} {won|fell ill|came third|lost the match|was fined}.
{Yesterday|Today|Later|In May|On Sunday|At last|Suddenly} {person} {found it|came home|won the race|sold the boat|rang the bell}.
{We know|They saw|She married|He follows|You remember|I trust} {person}{.|, don't we?| very well.}
{Gestern|Heute|Später|Im Mai|Am Sonntag|Endlich|Zuletzt} {fand|kam|siegte|verkaufte|rief|traf} {person} {den Hund|das Boot|nach Hause|im Rennen|die Post}.
{Die Sängerin|Der Bäcker|Der Pilot|Ihr Onkel|Der Maler|Sein Freund|Die Ärztin} {person} {siegte|wurde krank|verlor das Spiel|kam als Dritter}.
{Zum|Als} {Vorsitzenden|Kassenwart|Torwart|Sieger|Gast} {wurde|kam|wählte man} {person}{.| bestimmt.| dazu.}
{Hier, |Demain, |Enfin, |Plus tard, |Hier |Soudain }{person} {a trouvé le chien|rentre|a vendu le bateau|a perdu}.
{La chanteuse|Le boulanger|Le pilote|Mon oncle|Le peintre|Notre amie} {person} {a gagné|est malade|a perdu le match|chante}.
{C'est|Voici|On cherche|Nous attendons|Chez|Avec} {person}{.|, enfin.| qui arrive.}
{Ayer |Mañana |Por fin |Luego |Hoy, }{person} {encontró el perro|vuelve|vendió el barco|perdió}.
{La cantante|El panadero|El piloto|Mi tío|El pintor|Nuestra amiga} {person} {ganó|está enferma|perdió el partido|canta}.
{Es|Llegó|Buscan a|Esperamos a|Con|Para} {person}{.|, por fin.| que llama.}
"{It works|Never again|We are ready}", said {person}{.| in Leeds.}
{person}'s {office|desk|notebook|account} {is on the second floor|was closed|is new}.
{Authors|Participants|Present|Guests|Members}: {person}, {person} and {person}{.|}
{Sketched|Photographed|Translated|Typed|Measured|Tested|Installed} by {person}{.|, then sent on.| on 4 July.}
The {samples|parts|trials|readings|tests} were {done|made|carried out|taken|sent} by {Dr. |Ms. |Mr. |}{person} {in our workshop|at night|and stored}.
The {prize|contract|house|mandate|licence} {went|was given|was granted|belongs} to {person}{.| in <year>.|, aged <n>.}
{Her|His|Their} {brother|teacher|neighbour|lawyer} {person} {lives nearby|moved away|paid the fee}.
{Also seen by|Quoted from|Courtesy of|c/o|cc:|From:|To:|Attn.} {person}
Der Bericht {stammt von|wurde verfasst von|kommt von|ist von} {|Herrn |Frau |Dr. }{person}{ aus <town>.|.| und liegt bei.}
{Herr|Frau|Dr.|Prof.|Herrn|Dipl.-Kfm.|Dipl.-Ing.} {person} {hat den Vertrag unterschrieben|kam zu spät|leitet die Abteilung|prüft die Rechnung|war nicht da}.
{Mein Name ist|Ich heiße|Ich bin|Hier spricht} {person}.
{Wir danken|Wir sprachen mit|Ich traf|Es schrieb uns|Gestern kam} {person} {für die Hilfe|im Büro|in <town>|wegen der Miete}.
{Sehr geehrte Frau|Sehr geehrter Herr|Liebe|Lieber} {person},
{Mit freundlichen Grüßen|Viele Grüße|Hochachtungsvoll|Mit bestem Dank|Ihr|Ihre}{\\n| }{person}
{Ansprechpartner|Sachbearbeiter|Verfasser|Urheber|Prüfer|Bearbeiterin|Bevollmächtigter|Zeuge|Mieterin|Patient|Leitung|Name|Erfinder|Vertreter}: {|Dr. |Frau |Herr }{person}{|.}
{gez.|i. A.|i. V.|Unterschrift:|unterzeichnet von} {person}
{Laut|Nach Auskunft von|Nach Meinung von|Im Auftrag von|Gemeinsam mit} {person} {war die Pumpe defekt|gab es keinen Fehler|endet die Frist im Mai|ist alles bezahlt}.
{person} {erklärte|schrieb|meinte|bestätigte|bemerkte}, {dass die Ware fehlt|der Versuch sei gelungen|es werde teurer}.
{Der Antrag|Die Klage|Das Konto|Die Vollmacht|Der Brief} von {person} {wurde abgelehnt|liegt vor|ist abgelaufen|vom 3. Mai fehlt}.
{Vollmacht|Quittung|Vertretung|Rechnung|Zeugnis} für {person}{.| ist hinterlegt.| anbei.}
{Die Proben|Die Versuche|Die Zeichnungen|Den Umbau} {machte|nahm|hat|prüfte} {|Frau |Herr }{person} {vor|gemacht|selbst|im Keller}.
{Le rapport|La lettre|L'étude|Le dessin} {est de|a été écrit par|a été revu par|vient de} {person}{.| en <year>.}
{M.|Mme|Mlle|Dr|Maître|Monsieur|Madame} {person} {a signé le contrat|est absente|dirige le service|a rappelé hier}.
{Je m'appelle|Je suis|Mon nom est|Ici} {person}.
{Nous remercions|J'ai vu|Nous avons rencontré|Il faut prévenir} {person} {pour son aide|à la gare|hier soir|avant lundi}.
{Cher|Chère|Bonjour} {person},
{Cordialement|Bien à vous|Salutations distinguées|Avec mes remerciements},{\\n| }{person}
{Auteur|Contact|Rédigé par|Vérifié par|Témoin|Locataire|Patient|Nom|Responsable|Conseil|Inventeur|Mandataire}{ :|:} {|Mme |M. }{person}{|.}
{signé|Signé|Lu et approuvé,|Signature :|Par ordre,|Signé :} {person}
{D'après|Selon|Au dire de|Avec l'accord de|De la part de} {person}, {tout est en ordre|la pompe fuyait|le délai expire en mai|la mesure est fausse}.
{person} {affirme|écrit|pense|a constaté|répond} que {le train est en retard|la vanne était fermée|le prix va monter}.
{Le mandat|La plainte|Le compte|Le pouvoir} {de|donné par|confié à|remis à} {person} {est clos|a été rejeté|est joint|reste valable}.
{par|à|de|avec|chez|remis à} {M.|Mme|MM.|Dr} {person}{.| hier.| et <w>.|}
{La machine|Le montage|L'essai|La réparation} {a été faite par|a été conduit par|est l'œuvre de} {|M. |Mme }{person} {l'an dernier|puis vérifiée|à Lyon}.
{El informe|La carta|El plano|La nota} {es de|fue escrito por|lo firmó|la revisó} {person}{.| en <year>.}
{Sr.|Sra.|D.|D.ª|Dra.|Don|Doña|El Sr.|La Sra.} {person} {firmó el contrato|no vino|dirige la oficina|llamó ayer}.
{Me llamo|Soy|Mi nombre es|Habla} {person}.
{Agradecemos a|Hablamos con|Ayer vi a|Hay que avisar a} {person} {su ayuda|en la estación|antes del lunes|por el retraso}.
{Estimado|Estimada|Querido|Hola} {person}{,|:}
{Atentamente|Un saludo|Cordialmente|Con afecto},{\\n| }{person}
{Autor|Contacto|Redactado por|Revisado por|Testigo|Inquilino|Paciente|Nombre|Responsable|Apoderado|Inventor|Representante}: {|D. |D.ª |Sra. }{person}{|.}
{firmado|Fdo.:|Firma:|Por orden,|Firmado:} {person}
{Según|A juicio de|De acuerdo con|En nombre de} {person}, {todo está pagado|la bomba perdía agua|el plazo acaba en mayo|no hubo fallo}.
{person} {afirma|escribió|cree|comprobó|contestó} que {el tren llega tarde|la llave estaba cerrada|subirán los precios}.
{La queja|El poder|La cuenta|El encargo} {de|otorgado por|concedido a|a favor de} {person} {está cerrada|fue rechazado|va adjunto|sigue en vigor}.
{Las pruebas|El montaje|La obra|La medida} {la hizo|lo hizo|las llevó a cabo|corrió a cargo de} {|el Sr. |la Sra. }{person} {y se repitió|en verano|con cuidado}.
""",
    "phone": """
{Please call|Call|Ring|Phone|Text|Dial|Reach us at|You can reach me on|We answer on} {phone} {before noon|for details|any time|on weekdays|before you send goods|to book a table}{.|}
{Tel|Tel.|Phone|Mobile|Fax|Cell|Telephone|Hotline|Office|Home|Direct line|Phone/Fax|T|M}{:|: |.:| :| } {phone}{|.}
{My|Our|The new|The office} {number|phone number|mobile number|extension} is {phone}{.|, please ring twice.}
{The workshop|The desk|The night guard|The laboratory} {answers|can be called|is on call} {at|on|under} {phone}{.| until six.}
{<w>|<W>|<Comp>|and|,|:|"|for|no} {phone}{ <w>|, <w>|)|.|;| <w> <w>| and <w>}
<W> <w> {<w>|<Comp>} {phone} {<w>|<Comp>} <w>{.|}
<W> <w> ({phone}) <w> <w>.
({phone}, {ask for Jim|weekdays only|office hours|ask for the foreman})
{Contact|Questions}: {phone} or in person.
{Telefon|Tel.|Mobil|Fax|Handy|Rufnummer|Zentrale|Durchwahl|Fernsprecher}{:|: |.:| } {phone}{|.}
{Bitte rufen Sie|Sie erreichen uns unter|Erreichbar unter|Anruf genügt:|Auskunft unter} {phone} {an|bis 17 Uhr|werktags|vor dem Versand}.
{Meine|Die neue|Unsere} {Nummer|Handynummer|Telefonnummer} {ist|lautet} {phone}.
{Tél|Tél.|Téléphone|Portable|Fax|Mobile|Standard}{ :|: |. :| } {phone}{|.}
{Appelez le|Appeler au|Vous pouvez nous joindre au|On répond au} {phone} {avant midi|le matin|pour réserver|en cas de panne}.
{Mon|Le nouveau} numéro est le {phone}.
{Tel.|Teléfono|Móvil|Fax|Tfno.|Centralita}{:|: |.:| } {phone}{|.}
{Llame al|Llámenos al|Puede llamar al|Contestamos en el|Información en el} {phone} {antes de comer|por las tardes|para reservar|si hay averías}.
{Mi|El nuevo} número es el {phone}.
""",
    "id_number": """
{Passport|Passport no.|Passport number|Passport No|Identity card|ID card no.|Identity card number|ID number|National ID|Personal ID no.|Social security no.|Social security number|SSN|SSN:|National insurance number|NI number|Identity no.|Citizen number}{:| |} {id_number}{|.| was shown.| is valid until <year>.}
{Her|His|My|The traveller's|The tenant's|The owner's} {passport|identity card|ID card|social security number|national insurance number} {is|has the number|carries the number|reads} {id_number}.
{The holder of|Bearer of} {passport|identity card} {|no. |number }{id_number} {may enter|has signed|lives abroad}.
{<w>|<W>|the|stolen|without|with} {passport|identity card|social security number|national insurance number|ID card} {|no. |number }{id_number} {<w>|has|was|no|is} <w>{.|}
{<w>|<W>|ohne|mit|der} {Reisepass|Ausweis|Personalausweis|Sozialversicherungsnummer} {|Nr. |Nummer }{id_number} {<w>|wurde|ist|<Comp>} <w>{.|}
{<w>|<W>|le|la|sans|avec} {passeport|carte d'identité|carte nationale d'identité|numéro de sécurité sociale} {|n° |numéro }{id_number} {<w>|a|est} <w>{.|}
{<w>|<W>|el|sin|con} {pasaporte|documento de identidad|DNI|NIE|número de la seguridad social} {|n.º |número }{id_number} {<w>|ha|es} <w>{.|}
{passport|identity card|SSN|social security number|ID card|national insurance number}{, |: | = | (|, namely |, that is }{id_number}{|)}{,| and} {twice|please|which was wrong|as printed}.
{Pass|Reisepass|Ausweis|Personalausweis|Sozialversicherungsnummer}{, |: | mit der Nummer | Nr. | mit Nummer |, also }{id_number}{,| und} {bitte|zweimal|wie gedruckt|abgelaufen}.
{passeport|carte d'identité|numéro de sécurité sociale}{, |: | numéro | portant le numéro |, soit }{id_number}{,| et} {deux fois|merci|périmé|comme imprimé}.
{pasaporte|documento de identidad|DNI|NIE|número de la seguridad social}{, |: | número | con el número |, es decir }{id_number}{,| y} {dos veces|gracias|caducado|como pone}.
{The guest|The witness|The buyer} {showed|presented|gave} {a passport|an identity card|his identity card} ({id_number}).
({SSN|passport|ID|identity card} {id_number})
{Reisepass|Reisepass-Nr.|Passnummer|Personalausweis|Personalausweis-Nr.|Ausweisnummer|Ausweis-Nr.|Ausweis Nr.|Sozialversicherungsnummer|Rentenversicherungsnummer|Ausweis|Personalausweisnummer}{:| |} {id_number}{|.| wurde vorgelegt.| gilt bis <year>.}
{Der Zeuge|Die Käuferin|Der Gast} {zeigte|legte} {den Pass|den Ausweis|den Personalausweis} {id_number} vor.
{Die Nummer des Ausweises|Die Nummer ihres Passes|Seine Ausweisnummer|Ihre Sozialversicherungsnummer} {ist|lautet} {id_number}.
{Passeport|Passeport n°|Passeport no|N° de passeport|Carte d'identité|Carte nationale d'identité n°|CNI n°|N° de sécurité sociale|Numéro de sécurité sociale|NIR}{ :| |} {id_number}{|.| en cours de validité.| a été vu.}
{Le client|La locataire|Le témoin} {a montré|a présenté} {le passeport|sa carte d'identité} {|n° }{id_number}.
{Son passeport|Sa carte d'identité|Son numéro de sécurité sociale} {est le|porte le numéro} {id_number}.
{Pasaporte|Pasaporte n.º|N.º de pasaporte|DNI|DNI n.º|NIE|Documento nacional|Número de la seguridad social|N.º de afiliación|Documento de identidad|Cédula}{:| |} {id_number}{|.| en vigor.| fue mostrado.}
{El testigo|La compradora|El huésped} {con DNI|con pasaporte|enseñó el pasaporte} {id_number} {firmó|salió|pagó la fianza}.
{Su DNI|Mi pasaporte|Su documento de identidad} {es el|tiene el número} {id_number}.
""",
    "email": """
{Write|Send a note|Send your file|Reply|Report faults|Mail} to {email} {for a copy|before Monday|to join|with your questions}{.|}
{Email|E-mail|Mail|email|Contact|Reply to|Web or mail|eMail}{:|: |} {email}{|.}
{My address is|You can reach me at|I read|She answers at|Reach the editors at} {email}{.| most days.}
{The files|Plans|Copies|The slides} {can be had|are available|may be ordered} from {<|}{email}{>|} {on request|for free}.
({email}), ({contact|mail|write to}: {email})
mailto:{email}
{<w>|<W>|<Comp>|and|,|:|(|"|for|via} {email}{ <w>|, <w>|)|.|;| <w> <w>| ONLY}
<w> <w> {email} {and|or|und|et|y|,|;} {email} <w>{.|}
<W> <w> ({email}) <w> <w>.
{A message|Spam|A complaint|An answer} {came|reached us} from {email} {at noon|in autumn|yesterday}.
{Contact|Questions|Bookings}: {email} or {phone}
{E-Mail|Mail|E-Mail-Adresse|Kontakt}{:|: } {email}{|.}
{Schreiben Sie an|Anmeldung unter|Bitte senden an|Unterlagen gibt es bei|Fragen an} {email} {bis Montag|mit Betreff|bitte}.
{Meine Adresse ist|Sie erreicht mich unter} {email}.
{Courriel|E-mail|Mél|Adresse électronique|Contact}{ :|: } {email}{|.}
{Écrivez à|Envoyez le dossier à|Inscription auprès de|Les plans se trouvent chez} {email} {avant lundi|sans tarder|pour réserver}.
{Correo|Correo electrónico|E-mail|Contacto}{:|: } {email}{|.}
{Escriba a|Envíe los papeles a|Las copias se solicitan a|Dudas a} {email} {antes del lunes|cuanto antes|con el título}.
""",
    "address": """
{She lives|He lives|They live|We live|The office is|Our shop is|The meeting is|The tenant stays} {at|in} {address}{.| and likes it.| since <year>.}
{Ship to|Deliver to|Send the parcel to|Bring it to|Return to|Post the form to|Bill to}{:|} {address}{|.| by train.| before noon.}
{Address|Home address|Office|Residence|Location|Registered office|Domicile|Venue|Residing at|Living at|Resident at}{:| |} {address}{|.}
{The goods|Spare parts|The archives|Boxes|The papers} are {kept|stored|held|waiting} at {address}.
{The house at|The flat at|A fire broke out at|He moved to|She was born at} {address} {was sold|last night|in <year>|is empty}.
({address})
<w> {<w>|<Comp>} {address} <w> <w>{.|}
{<W>|the|la|le|der|dem|das|du} {<w>|<Comp>} {|at |in |, }{address}{,| ist| est| es| is|} <w>{.|}
{A van|The bus|The march|The parade} {stopped|waits|ends} {outside|in front of|near|opposite} {address}{.| at noon.}
{The bakery|The museum|The bar|My aunt's flat|The clinic}{ at|,| on} {address}, {is open|sells bread|has moved|was flooded}.
{Ein Auto|Der Bus|Der Umzug} {hielt|wartet|endet} {vor dem|in der|an der|im|in dem|beim|vor der|vor} {address}{.| um zwölf.}
{Die Praxis|Das Kino|Die Bar|Unsere Werkstatt|Die Post} {in der|im|an der|am|in den} {address} {ist zu|zieht um|brannte ab}.
{Er|Sie} zog {im Mai|gestern|damals|letztes Jahr} {in die|in den|ins|nach} {address}{.| um.}
{Une voiture|Le bus|Le défilé} {attend|s'arrête|finit} {devant le|près du|au|face au} {address}{.| à midi.}
{La clinique|Le cinéma|Le bar|La poste} {du|au|situé} {address} {est fermé|a brûlé|déménage}.
{Un coche|El autobús|El desfile} {espera|para|acaba} {frente a|delante de|en la|en el|junto a} {address}{.| a mediodía.}
{La clínica|El cine|El bar|La imprenta} {de la|del|de|en la} {address} {está cerrada|ardió|se muda}.
{Er wohnt|Sie wohnt|Wir wohnen|Die Firma sitzt|Das Büro liegt|Die Ware lagert|Die Akten liegen} {im|in|in der|am} {address}.
{Anschrift|Adresse|Wohnort|Lieferadresse|Rechnungsadresse|Sitz|wohnhaft|Wohnhaft|wohnt in}{:| |} {address}{|.}
{Lieferung an|Bitte senden an|Zurück an|Abholung bei} {address}{.| bis Freitag.}
{Das Haus|Die Wohnung} {address} {steht leer|wurde verkauft}.
{Elle habite|Il habite|Nous habitons|Le bureau se trouve|La réunion a lieu|Les archives sont} {au|à|} {address}{.| depuis <year>.}
{Adresse|Domicile|Siège|Adresse de livraison|Lieu|demeurant|Domicilié|résidant}{ :| | au } {address}{|.}
{Livrer au|Envoyer le colis au|Retour au} {address}{.| avant midi.}
{Vive en|Viven en|La oficina está en|La tienda abre en|El archivo está en|Se mudó a} {address}{.| desde <year>.}
{Dirección|Domicilio|Sede|Dirección de envío|Lugar|con domicilio en|domiciliado en|residente en}{:| |} {address}{|.}
{Enviar a|Entregar en|Devolver a} {address}{.| antes del lunes.}
""",
}

#: What looks personal and isn't.
DECOYS = """
<cap> {& <cap>|and Sons|& Co|Brothers|Industries|Holdings|Motors|Pharma|Software} {Ltd|Inc.|LLC|plc|Corp.|GmbH|AG|KG|SA|SARL|S.A.|S.L.} {made the seals|won the order|sells paint|will merge|delivers the casing|moved}.
{<given> <cap>|<cap> <cap>|<given>} {GmbH|AG|Ltd|Inc.|KG|SARL|S.A.|Pumps Ltd|Bakery|Tools Inc.|Hotel|Bank} {shipped the goods|is hiring|hat geliefert|a livré les joints|vende piezas|makes pumps}.
{The|A|This} <cap> {effect|engine|cycle|cage|theorem|equation|test|number|bridge|clamp|valve|pump|law|lens} {was used|is well known|explains the drift|needs two stages|with one spring is enough}.
{The|A} <given> {engine|pump|joint|seal|method|clamp|press} {is described elsewhere|was built twice|has no cover}.
{Das|Ein|Dieses} {<cap>|<given>}-{Verfahren|Ventil|Getriebe|Prinzip|Gesetz|Rad} {wird oft benutzt|ist alt|gilt als sicher}.
{Le|Un|Cet} {effet|moteur|théorème|procédé|pont} {<cap>|<given>|de <cap>} {est ancien|se voit souvent|sert ici}.
{La|Una|Esta} {ley|rueda|prensa|máquina} {<cap>|<given>|de <cap>} {es antigua|sirve aquí|se vende}.
{The <cap> Institute|<cap> University|University of <town>|The <cap> Prize|Mount <cap>|Lake <cap>|Port <town>|Saint <town>|New <town>|North <cap>|<town> Airport} {is closed|opens in May|was founded in <year>|lies in the north}.
{New York|San Francisco|Los Angeles|Buenos Aires|Hong Kong|South Africa|Puerto Rico|New Zealand|Costa Rica|North Sea|Middle East|Bad Homburg|Sri Lanka|El Salvador} {is far away|hosted the fair|exports tea|voted twice|was cold}.
{The European Commission|The United Nations|The Federal Office|The Supreme Court|The Patent Office|The City Council|The World Bank|Deutsche Bahn|Das Bundesamt|Le Conseil d'État|El Tribunal Supremo|La Cour de cassation|Das Amtsgericht <town>} {has decided|hat entschieden|a décidé|ha decidido}.
{Annual Report|Technical Data|Table of Contents|Terms and Conditions|General Information|Safety Notes|Summary of Findings|Allgemeine Hinweise|Technische Daten|Conditions générales|Datos técnicos|Inhalt und Zweck}
{Monday|Tuesday|Friday}, {January|March|October} <n>, <year> {was a holiday|is the last day|at noon}.
{Chief Executive Officer|Vice President|Head of Sales|Senior Engineer|Managing Director|Leitender Ingenieur|Directeur Général|Director General} {since <year>|resigned|hat gekündigt|a démissionné|ha dimitido}.
{Mr.|Mrs.|Ms.|Dr.|Herr|Frau|M.|Mme|Sr.|Sra.} <cap> {was late|agreed|kam später|est parti|no vino}.
<given> {was late again|called twice|kam zu spät|est en retard|llegó tarde}.
{Thanks to|We met|Ask|Mit|Avec|Con} <given> {it worked|geht es|ça marche|todo va bien}.
{Section|Chapter|Room|Building|Floor|Gate|Platform|Highway|Route|Exit|Claim|Table|Figure|Step|Unit} <n> {is closed|of the Act|was built in <year>|leads north|shows a bolt}.
{Abschnitt|Kapitel|Zimmer|Halle|Gleis|Tor|Platz|Absatz|Anlage|Stufe} <n> {ist gesperrt|gilt hier|fehlt|der Anlage bleibt frei}.
{The road|The lane|The square|The avenue|The drive|The court} {between posts <n> and <n>|lamp <n> in FIG. <n>|with <n> trees|past mark <n>} {is narrow|was painted|stays free}.
{Die Straße|Der Weg|Die Gasse|Der Platz} {mit <n> Lampen|bei Mast <n>|hinter Tor <n>} {ist eng|bleibt leer|dient der Prüfung}.
{La rue|La place|Le chemin} {avec <n> lampes|du secteur <n>|près de la borne <n>} {est étroite|reste libre}.
{La calle|La plaza|El camino} {con <n> faroles|del tramo <n>|junto al poste <n>} {es estrecha|queda libre}.
{Say|With|If|Where} {a@b|p@q|u@n|m@k}{.c|} {stands for the sum|is the value of a in b|is a map}{.|; so is u@v.}
{The value|The slope|The load|The curve} {at|near} {x@t|low speed|point P|the dot|noon} {is small|was plotted|bends}.
{at a dot on the map|look at example two|at most two dot signs|met at dawn|am at home}
{Tokyo and Kyoto|Paris and Lyon|Rome or Milan|Essen und Köln|Lima y Quito} {are old|sind alt|sont belles|son grandes}.
{the|The|a|our|at the|near the} {<W>|<town>|Grand|Royal|Old|Golden|Blue|City|<given>|<cap>} {Cinema|Hotel|Museum|Club|Party|Award|Cup|Festival|Theatre|Palace|Park|Station|Church|School|College|Trail|Show|Tower|Bridge|Times|Post|Eve|Day|Week|Forest|Bay|Cake|Street Market|Line|Road Race} {was {full|busy}|opens {late|in May}|won <n> {prizes|votes}}.
{Mont|Monte|Lac|Val|Cap|Isla|Sierra|Santa|San|Cape|River|Castle|Bad|Schloss|Château|Puerto|Villa|Îles|Costa|Playa} <town> {is high|liegt im Süden|est loin|queda lejos|lies to the west}.
{Der|Das|Die|Am|Zum|Beim} {Tag der|Rat der|Haus der|Fest der|Neue|Große|Alte|Deutsche|<town>er|Blaue|Rote} <Comp> {bleibt zu|war voll|tagt heute|wurde <n> Jahre alt}.
{Die|Der|Unsere|Eine} {<cap> AG|Firma <cap>|<cap> GmbH|Stadt|Bahn} {baut|liefert|kauft|sucht|prüft} in <town> <Comp>{en|n|} {für <n> Euro|und <Comp>en|}.
{La société|L'entreprise|Le groupe} <cap>{| SA| et fils} {vend|fabrique|livre} des <w>s à <town>{.|-<town>.}
{La empresa|La firma|El grupo} <cap>{| SA| e hijos} {vende|fabrica|entrega} <w>s en <town>{.|-<town>.}
{Le|La|Les} {Tour de|Fête de|Musée de|Prix de|Gare de} <town> {a lieu|est fermée|plaît} {demain|<n> jours}.
{El|La|Los} {Camino de|Feria de|Museo de|Vuelta a|Puerto de} <town> {abre|cierra|tiene} {mañana|<n> días}.
{La loi|La ley|Das Gesetz|The law|Der Vertrag} {du|de|vom|of} <n> {juillet|julio|Juli|July} <year> {protège|protege|schützt|protects} {les <w>s|los <w>s|die <Comp>en|<w>s}.
{Windows Server|Apple Watch|Red Cross|Black Sea|Big Ben|Blue Danube|Golden Gate|Star Wars|Grand Hotel|Old Town} {is popular|costs more|was closed}.
{The rule|Article|Paragraph|§|Art.} <n> {of the Code|BGB|du code|de la ley} {applies|gilt|s'applique|rige}.
"""

#: Numbers of things and files.
NUMBERS = """
{Lot|Batch|Order|Sample|Invoice|Case|File|Ticket|Part|Item|Serial|Article|Job|Box} {no. |number |}{<digits3>-<digits2>-<digits4>|<digits3> <digits2> <digits4>|<upper><upper><digits7>|<upper><upper>-<digits4>-<digits4>-<digits2>|<digits8><upper>|<digits5>/<digits3>} {was returned|is missing|arrived late|concerns a pump|was dried}.
({lot|batch|order|sample|case|ref.|file} {<digits3>-<digits2>-<digits4>|<digits3> <digits2> <digits4>|<upper><upper><digits7>|<digits4>-<digits4>-<digits2>})
{Los|Charge|Auftrag|Akte|Probe|Rechnung|Vorgang|Teil} {Nr. |}{<digits3>-<digits2>-<digits4>|<digits3> <digits2> <digits4>|<upper><upper><digits7>|<upper><upper>-<digits4>-<digits4>-<digits2>|<digits8>} {ging zurück|fehlt|wurde gesperrt|betrifft etwas anderes}.
{Lot|Commande|Dossier|Échantillon|Facture|Pièce} {n° |}{<digits3>-<digits2>-<digits4>|<digits3> <digits2> <digits4>|<upper><upper><digits7>|<digits2> <digits2> <digits2> <digits2> <digits2>|<digits8>} {est perdu|a été refusé|concerne une pompe}.
{Lote|Pedido|Expediente|Muestra|Factura|Pieza} {n.º |}{<digits3>-<digits2>-<digits4>|<digits3> <digits2> <digits4>|<upper><upper><digits7>|<digits2>.<digits2>.<digits2>.<digits2>.<digits2>|<digits8>} {se perdió|fue devuelto|trata de otra cosa}.
{Order code|Part no.|Catalogue no.|ISBN|Article number|Model|Bestellnummer|Artikelnummer|Référence|Código} {<digits3>.<digits3>.<digits4>|<digits3>-<digits3>-<digits2>|<digits3>-<digits1>-<digits5>-<digits3>-<digits1>|<digits3>/<digits5>|<upper><digits2>-<digits5>} {stands for a bush|is sold out|fits|passt nicht|manque|no existe}.
{Application|Publication|Patent|Anmeldung|Demande|Solicitud} {no. |Nr. |n° |n.º |}{<digits2> <year> <digits3> <digits3>|US <digits7>|EP <digits7>|<digits2>/<digits6>|WO<year>/<digits6>} {is pending|was refused|wurde veröffentlicht|est citée|fue retirada}.
{Serial number|The stamp|The plate reads|Seriennummer|N° de série|N.º de serie} <upper><upper> <digits4> <digits4> <digits2>{.| on the back.| auf der Rückseite.}
{See|Compare|Read|Vgl.|Siehe|Voir|Véanse} {pages|pp.|lines|Seiten|S.|les pages|las páginas} <digits3>-<digits3>{.| of the guide.| des Handbuchs.}
{From|Between} <year>-<n2>-<n2> {to|and} <year>-<n2>-<n2> {the line stood still|nothing was logged}.
{The total is|It costs|They paid|Das kostet|Cela coûte|Costó} {<n> <digits3> <digits3> EUR|<n>,<digits3>,<digits3> dollars|<n>.<digits3>,<digits2> Euro|<n> <digits3> francs}.
{The server|Host|Version} {<n2>.<n2>.<n>.<n>|<n2>.<n2>.<n2>} {is down|was released|answers}.
{Drawing|Class|Norm|Standard|Zeichnung|Norme|Plano} <upper><upper><digits4>-<digits2> {applies|gilt|s'applique|vale}; {batch|item|Teil} <digits4>-<digits4>-<digits2>.
{Figures|Items|Nos.|Nummern|Numéros|Los números} <digits4> {and|und|et|y} <digits3> {mark bolts|bezeichnen Schrauben|désignent des vis|son tornillos}.
{Sensor|Gauge|Station|Counter|Feeder} {<upper><digits5>|<upper><upper> <digits7>|<digits3> <digits3> <digits4>} {reads zero|was replaced|sends data}.
{Part|Standard part|Spare part|Norm part|Ersatzteil|Normteil|Pièce|Recambio} {no. |Nr. |n° |n.º |}{<digits3>/<digits5>|<digits3>.<digits3>.<digits4>|<digits3> <digits3> <digits3>|<upper><upper><digits4>-<digits2>|<digits9>} {fits|is used|wird benutzt|convient|se usa}.
{The|This|A|Our} {application|patent|file|order|drawing|lot|batch|invoice|parcel|ticket|receipt|machine} {|no. |number |code }{<digits2> <year> <digits3> <digits3>|<upper><upper>-<digits4>-<digits4>-<digits2>|<digits3>-<digits2>-<digits4>|<upper><upper><digits7>|<digits3>.<digits3>.<digits4>|<digits3>-<digits3>-<digits4>|<upper><upper><digits4>-<digits2>} {is on hold|was lost|is cited above|follows|expired}.
{Das|Die|Der|Ein|Im} {Los|Charge|Akte|Auftrag|Paket|Zeichnung|Aktenzeichen|Bestellung} {|Nr. }{<digits2> <year> <digits3> <digits3>|<upper><upper>-<digits4>-<digits4>-<digits2>|<digits3>-<digits2>-<digits4>|<upper><upper><digits7>|<digits3>.<digits3>.<digits4>|<digits3>/<digits5>} {ruht|ging verloren|wurde erwähnt|folgt}.
{Le|La|Un|Cette|Du} {lot|dossier|commande|colis|plan|brevet|facture} {|n° |numéro }{<digits2> <year> <digits3> <digits3>|<upper><upper>-<digits4>-<digits4>-<digits2>|<digits3>-<digits2>-<digits4>|<upper><upper><digits7>|<digits2> <digits2> <digits2> <digits2> <digits2>|<digits3>/<digits5>} {est en attente|est cité|suit}.
{El|La|Un|Este|Del} {lote|expediente|pedido|paquete|plano|billete|factura} {|n.º |número }{<digits2> <year> <digits3> <digits3>|<upper><upper>-<digits4>-<digits4>-<digits2>|<digits3>-<digits2>-<digits4>|<upper><upper><digits7>|<digits2>.<digits2>.<digits2>.<digits2>.<digits2>|<digits3>/<digits5>} {espera|se cita|sigue}.
"""

#: Plain sentences.
PLAIN = """
{The|A|Each|Every|This} {<w> |}{pump|arm|plate|frame|belt|lever|hose|wheel|tray|sheet|panel|spindle|cover|coil|chip} {(<n>) |}{is {held|driven|cooled|fixed|moved|cut|bent|sealed} by {the|a} {<w>|bolt|spring|motor|clip|gear|pin}|turns|rests on the {<w>|beam|base|floor}|may be {removed|replaced|turned}}{.| when {warm|wet|idle|<n> bar is reached}.| after <n> {days|minutes|turns}.}
{However|Therefore|Finally|Likewise|Usually|Thereafter|Otherwise|Still|Similarly|Thus}, {the {<w>|pump|arm|plate|cover} {stops|is lifted|must be dry}|a gap of <n> mm is left|no {oil|water|air} is lost|the price falls}.
{In|For|By|With|On|At|From|To|Of|Under} {this {way|case|test|mode}|some {forms|cases|plants}|figure <n>|a second step|contrast|most cases|rest}, {the {<w>|shaft|door|wire|bath} is {heated to <n> °C|weighed|left as it is|shown in part}|<n> to <n> mm {are|were} enough}.
{FIG.|Fig.|Figure} <n> {is a {side|top|rear} view of the {<w>|lever|frame}|gives the {load|flow|path} over time|depicts a {<w>|tray|hose} (<n>)}.
{A kit|A machine|A process|An apparatus|A system|A unit|Use|Kit} {according to|as in|of|under} {claim|item|point} <n>{| or <n>}, {wherein|where|in which} the {<w>|cover|belt} {is made of {steel|glass|brass}|has <n> teeth|carries a {<w>|coil}}.
{Test|Sample|Series|Trial|Run|Sheet} <n> {was {kept|dried|held|run} at <n> {kPa|°C|bar|volts} for <n> {minutes|hours|days}|gave <n> % {more|less}|failed}.
{The weather|The council|The market|The school|Our team|The library|Traffic|The harvest} {was calm|met on Monday|rose by <n> percent|is open until six|lost <n> to <n>|came late}{.| last year.| in March.}
{Die|Der|Das|Eine|Ein|Jede} {<Comp>|Platte|Pumpe|Welle|Klappe|Leitung|Halterung|Scheibe} {(<n>) |}{{wird|ist|bleibt} {gehalten|gekühlt|geöffnet|warm|trocken}|dreht sich|liegt auf {dem|der} {<Comp>|Boden|Träger}|{hält|trägt|führt} {den|die|das} {<Comp>|Motor|Feder|Rohr}}{.| nach <n> {Tagen|Stunden|Umdrehungen}.| bei <n> bar.}
{Danach|Außerdem|Zudem|Dabei|Weiterhin|Meist|Jedoch|Zuletzt|Dann|Sonst|Beispielsweise}{:| ferner:|} {{wird|ist|bleibt} {die|der|das} {<Comp>|Klappe|Motor|Rohr} {frei|leer|gelöst}|sinkt der {Druck|Preis|Strom}|folgt {ein|eine} {<Comp>|Pause|Schritt}}{.| auf {Luft|Stickstoff|Wasser}.}
{In|Bei|Nach|Mit|Unter|Zur|Im|Am|Für} {dieser|einer|jeder|der} {<Comp>|Stufe|Lage|Form|Probe} {wird|ist|liegt} {die|der|das} {<Comp>|Länge|Masse|Kraft|Zeit}{, {die|den|das} {die|der|das} {<Comp>|Welle|Motor} {hat|braucht|misst},|} {<n> mm|bei <n> °C|über <n> N|zwischen <n> und <n>}.
{Abbildung|Bild|Fig.|Tafel} <n> {zeigt {die|den|das} {<Comp>|Klappe|Träger} {von oben|im Betrieb|vergrößert}|gibt den {Verlauf|Weg} wieder}.
{Anlage|Gerät|Anordnung|Maschine|Werkzeug} {gemäß|nach} {Punkt|Ziffer|Satz} <n>, {bei dem|bei der|wobei} {die|der|das} {<Comp>|Deckel|Riemen} {aus {Stahl|Glas|Messing} besteht|<n> Zähne hat|{drehbar|lösbar} ist}.
{Alle|Neue|Alte|Manche|Weitere|Übliche|Solche|Beide|Andere} {<Comp>|Geräte|Pumpen|Teile|Lösungen|Leute|Firmen} {haben|brauchen|kosten|zeigen} {mehr|wenig|keine} {<Comp>|Platz|Zeit|Strom|Geduld}.
{Der Rat|Die Stadt|Das Wetter|Die Schule|Der Markt|Unser Verein} {tagte am Montag|wuchs um <n> Prozent|war ruhig|verlor <n> zu <n>|schließt um sechs}.
{Probe|Versuch|Muster|Lauf} <n> {wurde <n> {Minuten|Stunden} {lang |}bei <n> {kPa|°C} {gelagert|getrocknet|gefahren}|ergab <n> %}.
{Le|La|Un|Une|Chaque|Cette} {<w>|pompe|plaque|tige|porte|roue|levier|cadre|cuve} {(<n>) |}{est {tenu|fixée|refroidie|coupé}|tourne|repose sur {la|le} {<w>|socle|poutre}|peut être {ôté|remplacée}}{.| après <n> {jours|minutes|tours}.| à <n> bars.}
{Ensuite|Enfin|Toutefois|Ainsi|Parfois|Souvent|Ici|Sinon|Notamment|Habituellement}, {{le|la} {<w>|pompe|plaque} {s'arrête|se soulève|reste sèche}|un jeu de <n> mm {subsiste|reste}|on perd {moins|plus} {d'huile|d'eau}|le prix baisse}.
{Dans|Pour|Avec|Sous|Par|Sur|En|À|Lors de} {ce {mode|test}|cet essai|cette {forme|étape}|la figure <n>|une seconde étape|ce {but|contexte}}, {{le|la} {<w>|tige|porte|bain} est {portée à <n> °C|pesé|visible en partie}|<n> à <n> mm suffisent}.
{FIG.|Fig.|Figure} <n> {est une vue {de côté|d'en haut} {du|de la} {<w>|levier|cuve}|donne la {charge|course}}.
{Machine|Appareil|Système|Ensemble|Kit|Usage} {conforme à|d'après|suivant} {le point|l'élément} <n>, {où|dont} {le|la} {<w>|couvercle|courroie} {est en {acier|verre|laiton}|porte <n> dents}.
{Les|Des|Ces|Certains|Tous les} {<w>s|moteurs|pièces|gens|marchés|travaux} {coûtent|demandent|montrent|ont} {plus|peu|trop} {d'air|de temps|de place}.
{Le conseil|La ville|Le temps|L'école|Le marché|L'équipe} {s'est réuni lundi|a gagné <n> à <n>|ferme à six heures|a crû de <n> pour cent|était calme}.
{El|La|Un|Una|Cada|Esta} {<w>|bomba|placa|rueda|palanca|puerta|barra|caja|correa} {(<n>) |}{{está|queda} {fija|sujeta|fría|cortada}|gira|se apoya en {la|el} {<w>|base|viga}|puede {quitarse|cambiarse}}{.| tras <n> {días|minutos|vueltas}.| a <n> bares.}
{Luego|Después|Por fin|Así|A veces|Aquí|Si no|No obstante|Normalmente|Asimismo}, {{el|la} {<w>|bomba|placa} {se para|se levanta|queda seca}|hay un juego de <n> mm|se pierde {menos|más} {aceite|agua}|baja el precio}.
{En|Para|Con|Bajo|Por|Sobre|Al|A|Durante} {este {modo|ensayo}|esta {forma|etapa}|la figura <n>|un segundo paso|este contexto}, {{el|la} {<w>|varilla|puerta|baño} {se pesa|llega a <n> °C|se ve en parte}|bastan <n> a <n> mm}.
{La FIG.|Fig.|La figura} <n> {es una vista {lateral|superior} {del|de la} {<w>|palanca|caja}|da la {carga|curva}}.
{Máquina|Aparato|Sistema|Conjunto|Kit|Uso} {conforme al|del|según el} {punto|apartado} <n>, {donde|cuyo} {<w>|tapa|correa} {es de {acero|vidrio|latón}|lleva <n> dientes}.
{Los|Las|Estos|Algunas|Todas las} {<w>s|motores|piezas|gentes|tiendas|obras} {cuestan|piden|muestran|tienen} {más|poco|mucho} {aire|tiempo|espacio}.
{El consejo|La ciudad|El tiempo|La escuela|El mercado|El equipo} {se reunió el lunes|ganó <n> a <n>|cierra a las seis|creció un <n> por ciento|estaba en calma}.
{y = <n>x + <n>|p = F/A|<formula> + <formula>|v² = <n> m/s|∑ k = 1 m □|a_{k} \\\\le b|&lt;b&gt;<n>&lt;/b&gt;|T1 - T2 ( II|[[fig:<n2>]]|<formula>, n = <n2>–<n2>|∫ f(x) dx|R3 (IV) n m|<formula> <n2> % (V)|<formula> <w> <formula> <w> <n2>|\\\\sqrt{a^2 + <n>|$$ <formula> $}
<formula>{| (<n>)|, <w> = <n>|-<formula>|( <formula> )<n>}
{<w>|by|im|au} <formula> {and|und|et|y} <formula>{.|, n = <n>.}
{read|see|siehe|mit|avec|con|by} {<Comp>|<w>|gauge|Teil|jauge|pieza|step|Schritt} <upper><digits3>{.|)|, {<w>|und|et} <w>.}
{und|and|et|y} {<Comp>|<w>} {|(}<upper><digits2>{|)} {<w>|ist|is|est|es} <w>{.|}
{<W>|<Comp>} {der|die|das|den|ein|eine|dem} <Comp> {(<n>) |}{<n> °C|<w>|ist|hat} {<w>|erreicht|braucht}, {wird|ist|<w>} {der|die|das} <Comp> <w>.
{Die|Das|Der|Eine|Alle|Übliche|Neue|Andere|<W>te|<W>e} {<Comp>|<Comp>en|Geräte|Lösungen} {haben|hat|<w>en|werden} {den|die|das|der} {<Comp>|Vorteil|Mangel}, dass {der|die|das} <Comp> <w>.
<W> {<w>|a|the|le|el|la|der|die} <w>{,|:|} <w> {<w>|<Comp>} <n> {<w>|mm|bar} {<w>|and|und|et}.
<W>{,|:} {the|le|la|el|der|die|das} {<w>|<Comp>} <w> {<w>|<Comp>} {<w>|<Comp>}.
<n>. {<W>|<Comp>} {<w>|nach|of|selon|según} {<w>|<Comp>|claim} <n>, <w> {the|der|le|el} {<w>|<Comp>} <w>.
{INTRODUCTION|RESULTS|SUMMARY|Contents:|METHOD|EINLEITUNG|Ergebnis:|INHALT|RÉSULTATS|Méthode :|MÉTODO|Índice:|Background|Notes:|Anhang:|Annexe :|Claims|Ansprüche|DESCRIPTION|ABSTRACT|Zusammenfassung|Abrégé|Resumen|Beschreibung|REVENDICATIONS|Reivindicaciones}
{The|What is} {claimed|invention|aim|object|main idea} is {a <w>|the use of a <w>|not bound to <w>s|simple}{.|:}
{Wherein|Whereby|Comprising|Including|Said} {the|a} {<w>|base|lid} {at least|fully|in part} {covers|meets|guides} the {<w>|rim|wire}.
{Preferably|Optionally|Suitably|Ideally|Obviously|Especially|Advantageously|Moreover|Furthermore}, {the {<w>|rim|lid} is {flat|smooth|one part}|once the {<w>|bath} is {full|<n> °C warm}, the {<w>|lid} opens}.
{Bevorzugt|Gegebenenfalls|Zweckmäßig|Erfindungsgemäß|Insbesondere|Ferner|Vorteilhaft|Hierbei}{:| gilt:|} {{die|der|das} {<Comp>|Deckel} ist {flach|glatt}|{ist|wird} {die|der|das} <Comp> {einteilig|gefaltet}|{die|der|das} <Comp>, {umfassend|gekennzeichnet durch} {die|den|das} <Comp>}{.|}
{De préférence|Éventuellement|Avantageusement|Par ailleurs|En outre|De plus}, {{le|la} <w> est {plat|lisse|fermée}|quand {le|la} <w> atteint <n> °C, {le|la} <w> s'ouvre}.
{De preferencia|En su caso|Ventajosamente|Por otra parte|Además|En particular}, {{el|la} <w> es {plano|lisa}|si {el|la} <w> llega a <n> °C, {el|la} <w> se abre}.
"""

_GIVEN = (
    "Anna Maria John Peter Michael Sarah David Laura James Emma Robert Julia Thomas Sophie Daniel Alice William Olivia George Helen Klaus Jürgen Heike Uwe Sabine Wolfgang Ingrid Matthias Katrin Björn Anke Dieter Ursula Lukas Annette "
    "Jean Pierre Marie Camille François Élodie Luc Chloé Hélène Thierry Benoît Nathalie Guillaume Aurélie Jacques Anaïs Carlos José Lucía Javier Carmen Pablo Elena Miguel Ana Sofía Diego Inés Álvaro Pilar Íñigo Rosa Paulo João "
    "Giulia Marco Paolo Chiara Jan Ewa Piotr Agnieszka Tomasz Ivan Olga Dmitri Natasha Lars Ingrid Søren Astrid Mikko Aino Yuki Hiroshi Wei Li Mei Ahmed Fatima Omar Leila Priya Arjun Nguyen Minh Kofi Amara Ólafur Zsófia István Eoin Siobhán"
).split()
_SURNAMES = (
    "Smith Brown Taylor Wilson Clarke Walker Hughes Evans Parker Morgan Cooper Bennett Schmidt Müller Weber Fischer Wagner Becker Hoffmann Schäfer Koch Bauer Richter Klein Wolf Neumann Krüger Hartmann Lange Köhler "
    "Dupont Martin Bernard Dubois Moreau Laurent Lefèvre Girard Mercier Lambert Rousseau Fontaine Chevalier Perrin García López Martínez Sánchez Pérez Gómez Ruiz Díaz Moreno Muñoz Álvarez Romero Navarro Torres Ortega Castillo Silva Santos "
    "Rossi Ferrari Ricci Conti Kowalski Nowak Wiśniewski Zieliński Novák Horváth Ivanov Petrov Johansson Lindberg Hansen Nielsen Virtanen Tanaka Suzuki Wang Chen Nguyen Tran Kim Patel Singh Khan Haddad Okafor Mensah O'Brien McDonald Jansen Visser Bakker"
).split()
_TOWNS = (
    "London Leeds Bristol York Oxford Dublin Boston Chicago Denver Austin Springfield Portland Berlin Hamburg Köln München Leipzig Bremen Mainz Ulm Kassel Wien Graz Zürich Basel Paris Lyon Lille Nantes Toulouse Rennes Dijon Tours Metz Genève "
    "Madrid Sevilla Valencia Bilbao Granada Murcia Toledo Burgos Lima Quito Bogotá Toronto Sydney Auckland Prague Warsaw Oslo Lisbon Milan"
).split()
_PARTICLES = "van|van der|van den|von|von der|zu|de|de la|del|di|da|dos|le|el|al|ten|bin|du|d'".split("|")
_STREET = {
    "en": "Street Road Lane Avenue Drive Court Close Way Place Square Terrace Gardens Hill Row St Rd. St. Ave Blvd. Boulevard Crescent Walk Mews Grove Green Park".split(),
    "de": "straße weg gasse allee platz ring damm ufer strasse steig pfad hof markt chaussee".split(),
    "fr": "rue avenue boulevard impasse place chemin quai allée route cours passage av. bd ruelle".split(),
    "es": "Calle Avenida Avda. Plaza Paseo C/ Camino Ronda Travesía Carretera Callejón Pza. Av. Cuesta".split(),
}
_STREET_BASE = {
    "en": "High Station Church Park Mill Garden King's Queen's Elm Oak Maple Victoria Green Castle Bridge River Spring Baker Main Second North Lake Sunset Harbour Cherry Abbey".split(),
    "de": "Haupt Bahnhof Garten Linden Kirch Schul Berg Wald Mühlen Rosen Schiller Goethe Eichen Birken Ring Dorf Feld Brunnen Post Buchen".split(),
    "fr": "de la Paix|de la Gare|Victor Hugo|des Lilas|du Moulin|de l'Église|Pasteur|des Écoles|du Port|de Paris|Saint-Michel|Jean Jaurès|de la République|du Marché|des Roses|d'Alsace".split("|"),
    "es": "Mayor|de Alcalá|del Sol|de la Constitución|Real|de los Olivos|San Juan|de las Flores|Nueva|del Carmen|Cervantes|de la Paz|del Prado|Gran Vía|de Toledo|Santa Ana".split("|"),
}
_ONSET = "b bl br c ch d dr f fl fr g gl gr h j k kl kn kr l m n p pl pr qu r s sch sl sp st str t th tr v w z".split()
_NUCLEUS = "a a e e i o o u ä ö ü é è á í ó ø å ñ ai au ei ie ou oa ee".split()
_CODA = ["", "", "", "b", "d", "g", "k", "l", "m", "n", "p", "r", "s", "t", "x", "ck", "ff", "ld", "ll", "lt", "nd", "ng", "nk", "rg", "rn", "rt", "ss", "tt", "tz", "v"]
_NAME_END = ["", "", "", "", "a", "o", "i", "e", "y", "son", "sen", "ski", "ska", "ez", "es", "ini", "ov", "ova", "ić", "man", "mann", "ton", "ham", "field", "er", "ier", "eau", "oux", "ström", "berg", "feld", "ak", "ek", "enko", "yan", "idis"]
_COMPOUND_END = "ung heit keit ring rad welle werk platte körper einheit kopf halter rohr folie schicht kammer kanal bett speicher geber träger stange lager feder arm stoff teil gerät kasten schraube messer pumpe trichter backe glied satz tafel faser zelle stelle quelle".split()
_WORD_END = {"en": ["", "", "er", "ing", "ed", "ness", "ation", "ly", "ment", "able"], "fr": ["", "e", "ion", "eur", "ement", "age", "é", "oir"], "es": ["o", "a", "ción", "dor", "miento", "ado", "e"], "de": ["", "en", "lich", "bar", "ig", "er"]}


#: Shares of words exchanged for unknown ones, so that forms count and not only the words around them.
UNKNOWN = (0, 0, 0, 0.25, 0.5, 0.75)
#: Words that tell what a number or a name is; kept where other words are exchanged for unknown ones.
TELLING = set(
    "passport identity card id ssn ni social security insurance national citizen number no personal reisepass reisepasses pass passnummer passes personalausweis ausweis ausweises ausweisnummer sozialversicherungsnummer rentenversicherungsnummer nr nummer "
    "passeport carte identité nationale cni sécurité sociale nir numéro pasaporte dni nie documento identidad seguridad social cédula número afiliación "
    "lot batch order sample invoice case file ticket part item serial article job box ref los charge auftrag akte probe rechnung vorgang teil commande dossier échantillon facture pièce lote pedido expediente muestra factura pieza "
    "code catalogue isbn model bestellnummer artikelnummer référence código application publication patent anmeldung demande solicitud us ep wo stamp plate seriennummer série serie pages pp lines seiten page páginas "
    "ltd inc llc plc corp gmbh ag kg sa sarl co sons brothers industries holdings motors pharma software bakery tools hotel bank pumps effect engine cycle cage theorem equation test bridge clamp valve pump law lens joint seal method press "
    "verfahren ventil getriebe prinzip gesetz rad effet moteur théorème procédé pont ley rueda prensa máquina institute university prize mount lake port saint airport section chapter room building floor gate platform highway route exit claim table figure step unit "
    "abschnitt kapitel zimmer halle gleis tor absatz anlage stufe drawing class norm standard zeichnung norme plano figures items nos nummern numéros números sensor gauge station counter feeder".split()
)


class Filler:
    """Fills slots from a seeded generator, so that the table is the same each time."""

    def __init__(self, seed: int, given: list[str]):
        self.r = random.Random(seed)
        self.given_names = given

    def _syllables(self, least: int, most: int) -> str:
        c = self.r.choice
        return "".join(c(_ONSET if self.r.random() < 0.85 else ["", "y", "x", "sz", "ç"]) + c(_NUCLEUS) + c(_CODA) for _ in range(self.r.randint(least, most)))

    def cap(self) -> str:
        if self.r.random() < 0.3:
            return self.r.choice(_SURNAMES)
        s = self._syllables(1, 2) + self.r.choice(_NAME_END)
        return s[:1].upper() + s[1:] if len(s) > 2 else self.cap()

    def town(self) -> str:
        if self.r.random() < 0.4:
            return self.r.choice(_TOWNS)
        t = self._syllables(1, 2).capitalize() + self.r.choice(["", "", "burg", "ton", "ville", "stadt", "dorf", "heim", "mouth", "ford", "a", "o"])
        x = self.r.random()
        return f"Saint-{t}" if x < 0.1 else f"{self.r.choice(['Bad', 'New', 'La', 'San', 'Le', 'Port', 'Old', 'Villa', 'Santa', 'North'])} {t}" if x < 0.3 else t

    def given(self) -> str:
        x = self.r.random()
        if self.given_names and x < 0.3:
            return self.r.choice(self.given_names)
        if x < 0.6:
            g = self.r.choice(_GIVEN)
            return f"{g}-{self.r.choice(_GIVEN)}" if self.r.random() < 0.08 else g
        s = self._syllables(1, 2) + self.r.choice(["", "", "", "a", "e", "o", "i", "us", "ine", "ette", "el"])
        return s.capitalize() if len(s) > 2 else self.given()

    def surname(self) -> str:
        s, x = self.cap(), self.r.random()
        return f"{s}-{self.cap()}" if x < 0.14 else f"{self.r.choice(['Mc', 'Mac', 'O’', 'D’', 'De', 'Fitz'])}{s}" if x < 0.18 else s

    def initial(self) -> str:
        return self.r.choice("ABCDEFGHIJKLMNOPQRSTUVWYZÀÁÅÄÇÉÈÍÑÓÖØÚÜŁŠŽ") + "."

    def person(self) -> str:
        x, g, s = self.r.random(), self.given(), self.surname()
        if x < 0.42:
            return f"{g} {s}"
        if x < 0.48:
            p = self.r.choice(_PARTICLES)
            return f"{g} {p}{'' if p[-1] in '’' + chr(39) else ' '}{s}"
        if x < 0.59:
            return f"{s}, {g}" if self.r.random() < 0.8 else f"{s}, {self.initial()}"
        if x < 0.69:
            return f"{s.upper()} {g}" if self.r.random() < 0.85 else f"{s.upper()}, {g}"
        if x < 0.80:
            return f"{g} {self.initial()} {s}"
        if x < 0.91:
            return f"{self.initial()} {s}" if self.r.random() < 0.8 else f"{self.initial()}{self.r.choice(['', ' '])}{self.initial()} {s}"
        if x < 0.94:
            return f"{g} {self.given()} {s}"
        if x < 0.96:
            return f"{g} {s} {self.cap()}"
        return f"{g} {s.upper()}" if x < 0.98 else f"{g}\n{s}"

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def phone(self) -> str:
        d, r = self.digits, self.r
        s = r.choice([" ", " ", "-", ".", "/", " – ", "‑", "\u00a0"])
        plus = r.choice(["+", "+", "+", "＋", "00", "+ "])
        forms = [
            lambda: f"{plus}{d(2)}{s}{d(2)}{s}{d(5)}{s}{d(3)}",
            lambda: f"{plus}{d(2)} (0){r.choice(['', ' '])}{d(2)} {d(5)}{s}{d(3)}",
            lambda: f"(0{d(r.choice([2, 3, 4]))}) {d(3)}{r.choice(['', s])}{d(r.choice([3, 4, 5]))}",
            lambda: f"0{d(2)}/{d(5)}{r.choice([' ', ''])}{d(3)}",
            lambda: f"{plus}1{s}{d(3)}{s}{d(3)}{s}{d(4)}",
            lambda: f"{plus}1 ({d(3)}) {d(3)}{r.choice(['-', ' '])}{d(4)}",
            lambda: f"({d(3)}) {d(3)}{r.choice(['-', ' ', '.'])}{d(4)}",
            lambda: f"{d(3)}{r.choice(['.', '-', ' '])}{d(3)}{r.choice(['.', '-', ' '])}{d(4)}",
            lambda: f"00{r.choice(['1', d(2)])} {d(3)} {d(3)} {d(4)}",
            lambda: f"{plus}{d(2)}{s}{d(4)}{s}{d(3)}{s}{d(3)}",
            lambda: f"0{d(3)}{s}{d(3)}{s}{d(3)}",
            lambda: f"0{d(r.choice([3, 4]))}{r.choice([' ', '-', '/'])}{d(6)}",
            lambda: f"{plus}{d(r.choice([2, 3]))} {d(r.choice([1, 2, 3]))} {d(3)} {d(4)}",
            lambda: f"{plus}{d(2)} {d(2)} {d(4)} {d(4)}",
            lambda: r.choice([" ", ".", "-", ""]).join(["0" + d(1), *(d(2) for _ in range(4))]),
            lambda: r.choice([" ", "."]).join(["0" + d(1), *(d(2) for _ in range(4))]),
            lambda: f"{plus}{d(2)} {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}",
            lambda: f"{r.choice('69')}{d(2)} {d(3)} {d(3)}",
            lambda: f"{plus}{d(r.choice([10, 11, 12]))}",
            lambda: f"0{d(r.choice([9, 10]))}",
            lambda: f"1{r.choice(['-', '.', ' '])}{d(3)}{r.choice(['-', '.', ' '])}{d(3)}{r.choice(['-', '.', ' '])}{d(4)}",
            lambda: f"0{d(r.choice([2, 3, 4]))}{r.choice(['/', ' ', '-'])}{d(r.choice([3, 4, 5]))}-{d(r.choice([1, 2, 3]))}",
            lambda: f"{d(3)} {d(2)} {d(2)} {d(2)}",
            lambda: f"0{d(4)} {d(3)} {d(3)}",
        ]
        return self._broken(r.choice(forms)())

    def id_number(self) -> str:
        d, u, r = self.digits, self.upper, self.r
        forms = [
            lambda: f"{d(3)}-{d(2)}-{d(4)}",
            lambda: f"{d(3)}-{d(2)}-{d(4)}",
            lambda: f"{d(3)} {d(2)} {d(4)}",
            lambda: f"{u()}{u()}-{d(4)}-{d(4)}-{d(2)}",
            lambda: f"{u()}{u()}-{d(4)}-{d(4)}-{d(2)}",
            lambda: f"{u()}{u()}{d(7)}",
            lambda: f"{u()}{d(8)}",
            lambda: f"{u()}{d(2)}{u()}{d(2)}{u()}{d(2)}",
            lambda: f"{u()}0{u()}{d(2)}{u()}{d(3)}{u()}",
            lambda: f"{d(8)}{self.r.choice(['', '-', ' '])}{u()}",
            lambda: f"{d(2)}.{d(3)}.{d(3)}-{u()}",
            lambda: f"{self.r.choice('XYZ')}{self.r.choice(['', '-'])}{d(7)}{self.r.choice(['', '-'])}{u()}",
            lambda: f"{u()}{u()} {d(2)} {d(2)} {d(2)} {u()}",
            lambda: f"{self.r.choice('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)}{self.r.choice(['', ' ' + d(2)])}",
            lambda: f"{self.r.choice('12')}{d(14)}",
            lambda: f"{d(2)} {d(6)} {u()} {d(3)}",
            lambda: d(9),
            lambda: f"{u()}{d(self.r.choice([5, 6, 7]))}",
            lambda: f"{d(2)}{u()}{u()}{d(5)}",
            lambda: f"{u()}{u()}{u()}{d(6)}",
            lambda: f"{u()}{u()}{r.choice([' ', ''])}{d(7)}",
            lambda: f"{u()}{d(r.choice([8, 9]))}",
            lambda: "".join(r.choice([u(), d(1), d(1)]) for _ in range(9)) + d(1),
            lambda: f"{d(2)} {d(8)} {d(2)}",
            lambda: d(12),
        ]
        return self._broken(self.r.choice(forms)())

    def _broken(self, text: str) -> str:
        """Now and then a line ends inside."""
        return text.replace(" ", "\n", 1) if self.r.random() < 0.04 else text

    def upper(self) -> str:
        return self.r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ")

    def email(self) -> str:
        r = self.r
        low = lambda: re.sub(r"[^\w-]", "", r.choice([self.cap, self.given])().lower())
        word = lambda: r.choice(["info", "office", "mail", "sales", "hello", "post", "kontakt", "team", "support", "press", "buero", "service"])
        local = r.choice(
            [
                lambda: f"{low()}.{low()}",
                lambda: f"{low()}.{low()}",
                lambda: f"{r.choice('abcdefghijklmnopqrstuvwxyz')}{r.choice(['', '.', '_'])}{low()}",
                lambda: f"{low()}{r.choice(['', '_', '.', '-'])}{low() if r.random() < 0.3 else ''}{self.digits(r.choice([1, 2, 4]))}",
                lambda: f"{low()}{r.choice('.-_')}{r.choice(['', low()[:1] + r.choice('.-_')])}{low()}",
                lambda: f"{low()}+{r.choice(['news', 'list', word(), low()[:4]])}",
                lambda: f"{low()}{r.choice('-_')}{low()}",
                word,
                low,
            ]
        )()
        end = r.choice(["com", "com", "org", "net", "de", "fr", "es", "co.uk", "eu", "io", "edu", "info", "at", "example", "test", "invalid"])
        domain = r.choice([lambda: f"{low()}.{end}", lambda: f"{low()}-{low()[:4]}.{end}", lambda: f"{r.choice(['mail', 'post', 'uni', 'web', 'shop', low()])}{r.choice('..-')}{low()}.{end}", lambda: f"{low()}.{r.choice(['example', 'co', 'ac', low()])}.{end}", lambda: f"{low()[:3]}-{low()}.{r.choice(['example', low()])}.{end}", lambda: f"{r.choice(['example', 'firma', 'company', 'maison', 'lab', 'archive'])}.{end}"])()
        if r.random() < 0.2:
            domain = f"{domain.rsplit('.', 1)[0]}.{r.choice(['example', 'co', 'mail', low()])}.{end}"
        x = r.random()
        if x < 0.14:
            at, dot = r.choice([(" at ", " dot "), (" AT ", " DOT "), (" (at) ", " (dot) "), (" [at] ", " [dot] ")])
            return f"{local}{at}{domain.replace('.', dot)}"
        if x < 0.16:
            return f"{local} at {domain}"
        out = f"{local}{r.choice(['(at)', '(at)', '{at}', '[at]']) if x < 0.22 else ' [at] ' if x < 0.28 else ' @ ' if x < 0.34 else '＠' if x < 0.40 else '@'}{domain}"
        return out.upper() if x > 0.92 else out.title() if x > 0.90 else out

    def address(self) -> str:
        r, d, u = self.r, self.digits, self.upper
        n = str(r.randint(1, r.choice([30, 250, 2000]))) + (r.choice(["a", "b", "c", " a", "A", "B", "-" + d(2)]) if r.random() < 0.1 else "")
        town, a, b = self.town(), self.cap(), self.cap()
        kind = r.choice(["en", "en", "de", "de", "fr", "es"])
        base = lambda: r.choice(_STREET_BASE[kind])
        if kind == "en":
            name = r.choice([base(), base(), a, a, f"{r.choice(['Old', 'Upper', 'East', 'West', 'Great'])} {a}", f"{r.choice('ENSW')}. {a}", f"{a}'s", f"{a} {b}"])
            street = f"{n} {name} {r.choice(_STREET['en'])}"
            x = r.random()
            flat = f", {r.choice(['Apt', 'Flat', 'Suite', 'Unit', 'Apt.', 'Floor'])} {r.randint(1, 40)}{r.choice(['', 'A', 'B', 'C'])}" if x < 0.25 else ""
            if x > 0.93:
                street = f"Flat {r.randint(1, 40)}, {street}"
            code = r.choice(["", "", f" {u()}{u()}{d(1)} {d(1)}{u()}{u()}", f", {u()}{u()} {d(5)}", f" {u()}{d(2)} {d(1)}{u()}{u()}", f", {u()}{u()} {d(5)}-{d(4)}", f" {d(5)}", f" {u()}{u()}{d(2)} {d(1)}{u()}{u()}"])
            out = street + flat + r.choice(["", f", {town}{code}", f", {town}{code}", f", {town}{code}"])
        elif kind == "de":
            street = r.choice(
                [
                    f"{r.choice([base(), a])}{r.choice(_STREET['de'])}",
                    f"{r.choice([base(), a])}{r.choice(_STREET['de'])}",
                    f"{r.choice(['Alte', 'Neue', 'Kleine', 'Lange', 'Hohe', 'Obere'])} {a}{r.choice(_STREET['de'])}",
                    f"{r.choice([a + 'er', base()])}{r.choice([' Str.', 'str.', ' Straße', '-Straße', ' Weg', ' Platz', ' Allee'])}",
                    f"{r.choice(['Am', 'An der', 'Im', 'Auf dem', 'Zum', 'In der', 'Am Alten', 'Hinter dem', 'Unter den'])} {r.choice([a, base()])}",
                    f"Straße {r.choice(['des', 'der', 'am'])} {a}",
                ]
            )
            out = f"{street} {n}" + r.choice(["", f", {d(5)} {town}", f", {d(5)} {town}", f", {r.choice(['D-', 'A-', 'CH-'])}{d(r.choice([4, 5]))} {town}", f", {town}", f" in {d(5)} {town}"])
        elif kind == "fr":
            name = r.choice([base(), base(), a, f"{r.choice(['du', 'des', 'de la', 'de'])} {r.choice(['Vieux', 'Grand', 'Petit', 'Trois', 'Belle', 'Neuf'])} {a}", f"{r.choice(['du', 'de', 'des', 'de la'])} {a}", f"{self.given()} {a}"])
            out = f"{n}{r.choice(['', '', '', ' bis', ' ter'])}{r.choice(['', '', ','])} {r.choice(_STREET['fr'])} {name}" + r.choice(["", f", {d(5)} {town}", f", {d(5)} {town}", f" à {town}", f", {town}", f" {d(5)} {town}"])
        else:
            name = r.choice([base(), base(), a, f"{r.choice(['del', 'de los', 'de las', 'de la', 'de'])} {a}", f"{a} {b}", f"del {a} {b}"])
            flat = f", {r.randint(1, 9)}.{r.choice(['º', 'ª', '°'])} {r.choice(['A', 'B', 'C', 'D', 'izq.', 'dcha.'])}" if r.random() < 0.3 else ""
            out = f"{r.choice(_STREET['es'])} {name}" + r.choice([f" n.º {n}", f" {n}", f" {n}", f", {n}", f" núm. {n}"]) + flat + r.choice(["", f", {town}", f", {d(5)} {town}", f", {d(5)} {town}", f" de {town}"])
        if r.random() < 0.1:
            at = out.rfind(", ")
            out = out[:at] + ",\n" + out[at + 2 :] if at > 0 else out.replace(" ", "\n", 1)
        return out

    def w(self) -> str:
        """A word in small letters that no list has."""
        return self._syllables(1, 2) + self.r.choice(_WORD_END[self.r.choice(["en", "en", "fr", "es", "de"])])

    def formula(self) -> str:
        part = lambda: self.r.choice(["C", "H", "O", "N", "CH", "NH", "Si", "Cl", "Na", "Fe", "COOH", "OH", "SO", "R", "X", "Ti"]) + self.r.choice(["", "", "2", "3", "4", "n", " 2", " n"])
        out = "".join(part() + self.r.choice(["", "", "", "-", " ", " - "]) for _ in range(self.r.randint(1, 4)))
        return self.r.choice([out, out, f"({out}){self.r.choice(['n', 'm', '2', '3'])}{part()}", f"{part()}({out}){self.r.choice(['n', 'm', '2'])}{part()}"]).strip(" -")

    def comp(self) -> str:
        """A long German noun."""
        return (self._syllables(1, 2) + self.r.choice(["", "s", "en", ""]) + self.r.choice(_COMPOUND_END)).capitalize()

    def worn(self, text: str) -> str:
        """A sentence as bad scans and bad translations have it: words repeated, lost, run together, cut at line ends, misread."""
        words = text.split(" ")
        i = self.r.randrange(len(words))
        how = self.r.randrange(6)
        if how == 0:
            words.insert(i, words[i])
        elif how == 1 and i + 1 < len(words):
            words[i : i + 2] = [words[i] + words[i + 1]]
        elif how == 2 and len(words[i]) > 5:
            words[i] = words[i][:3] + "-\n" + words[i][3:]
        elif how == 3 and len(words) > 2:
            del words[i]
        elif how == 4:
            words[i] = words[i] + "\n"
        else:
            old, new = self.r.choice([("l", "1"), ("m", "rn"), ("o", "0"), (",", " ,"), (".", " ."), ("ü", "Ã¼"), ("c", "ç")])
            return text.replace(old, new)
        return " ".join(words)

    def unknown(self, text: str, share: float) -> str:
        """``text`` with a share of its words (but those that tell kinds of numbers and firms) replaced by words that no list has."""

        def other(m: re.Match) -> str:
            word = m.group()
            if word.lower() in TELLING or len(word) == 1 or self.r.random() >= share:
                return word
            new = self.comp() if word[0].isupper() and self.r.random() < 0.3 else self.w()
            return new.upper() if word.isupper() else new.capitalize() if word[0].isupper() else new.lower()

        return re.sub(r"[^\W\d_]+", other, text)

    def slot(self, name: str) -> str:
        if name == "W":
            return self.w().capitalize()
        if name.startswith("digits"):
            return self.digits(int(name[6:]))
        if name == "n":
            return str(self.r.randint(1, self.r.choice([9, 60, 400])))
        if name == "n2":
            return f"{self.r.randint(1, 12):02d}"
        if name == "year":
            return str(self.r.randint(1950, 2030))
        return getattr(self, name.lower())()

    def choose(self, frame: str) -> str:
        """One part of each ``{a|b}``, innermost first."""
        while m := re.search(r"\{([^{}|]*(?:\{\w+\}[^{}|]*)*(?:\|[^{}|]*(?:\{\w+\}[^{}|]*)*)+)\}", frame):
            frame = frame[: m.start()] + self.r.choice(m.group(1).split("|")) + frame[m.end() :]
        return frame

    def fill(self, frame: str) -> list[tuple[str, str]]:
        """(text, type or empty) pieces of a frame."""
        out: list[tuple[str, str]] = []
        for piece in re.split(r"(\{(?:email|phone|id_number|address|person)\}|<(?:cap|given|upper|town|year|w|W|Comp|formula|n2|n|digits\d)>)", self.choose(frame).replace("\\n", "\n")):
            if piece[1:-1] in TYPES:
                out.append((self.slot(piece[1:-1]), piece[1:-1]))
            elif len(piece) > 2 and piece[0] == "<" and piece[-1] == ">":
                out.append((self.slot(piece[1:-1]), ""))
            elif piece:
                out.append((piece, ""))
        return out


def lines(block: str) -> list[str]:
    return [x for x in block.strip().split("\n") if x]


def known_names(seed: int, n: int = 150) -> list[str]:
    """Made-up given names that count as known beforehand in training, so that the field learns what it means to be known, whichever names are given later."""
    f = Filler(seed, [])
    return [f.given() for _ in range(n)]


def labelled(n: int, seed: int, given: list[str]) -> list[list[tuple[str, str]]]:
    """``n`` labelled passages of a few sentences, as pieces of text with their type. ``given`` are among the given names."""
    f = Filler(seed, given)
    r = f.r
    frames = {t: lines(b) for t, b in FRAMES.items()}
    frames |= {"decoy": lines(DECOYS), "number": lines(NUMBERS), "plain": lines(PLAIN)}
    turn = {t: r.randrange(len(frames[t])) for t in frames}
    kinds = [*TYPES, *TYPES, "id_number", "id_number", "phone", "email", "person", "person", "person", "decoy", "decoy", "decoy", "number", "number", *["plain"] * 5]
    out = []
    for _ in range(n):
        pieces: list[tuple[str, str]] = []
        for k in range(r.randint(1, 3)):
            if k:
                pieces.append((r.choice([" ", " ", " ", "\n", "\n\n", f"\n\n[{f.digits(4)}] ", f"\n{k}. ", " (", "\n- "]), ""))
            t = r.choice(kinds)
            got = f.fill(frames[t][turn[t] % len(frames[t])])  # each frame in turn
            turn[t] += 1
            share = r.choice(UNKNOWN)
            if share:
                got = [(p if k_ else f.unknown(p, share), k_) for p, k_ in got]
            if t in ("plain", "decoy", "number") and r.random() < 0.25:
                got = [(f.worn("".join(p for p, _ in got)), "")]
            if t == "plain" and r.random() < 0.2 and got[-1][0].endswith("."):  # the next sentence begins without a full stop between
                got[-1] = (got[-1][0][:-1], "")
            pieces += got
        out.append([p for p in pieces if p[0]])
    return out


def frame_words() -> set[str]:
    """Lower-case words of the frames themselves, without what fills the slots, and the words of addresses: the vocabulary of the model."""
    text = re.sub(r"<\w+>|\{(?:email|phone|id_number|address|person)\}", " ", "\n".join([*FRAMES.values(), DECOYS, NUMBERS, PLAIN])).replace("\\n", " ")
    more = [w for k in ("en", "fr", "es") for w in _STREET[k]] + [p for x in _PARTICLES for p in x.split()] + "Apt Flat Suite Unit Floor Str Straße Weg Platz Allee Am An Im Auf dem Zum Alten Hinter Unter den Alte Neue der des bis ter à n núm izq dcha dot at com org net de".split()
    return {w.lower() for w in re.findall(r"[^\W\d_]+", text + " " + " ".join(more))}
