"""The random field: held-out accuracy, exact sums against brute force, placeholders, odd inputs."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from foldsearch.llm import crf, pii, pii_labelled


@pytest.fixture(scope="module")
def model():
    """Trained as the queries train."""
    return pii.trained()


def test_decoding_is_the_best_path():
    r = np.random.default_rng(1)
    labels = ["O", "B-x", "I-x"]
    moves, starts = crf.allowed_moves(labels)
    moves = moves + r.normal(size=(3, 3)) * (moves == 0)
    m = crf.Model(labels, 1, {}, np.zeros((1, 0, 2)), np.zeros((1, 1, 2)), moves, starts, [])
    e = r.normal(size=(6, 5, 3)).astype(np.float32)
    lengths = np.array([5, 4, 3, 2, 1, 5])
    got = m.decode(e, lengths)
    for i, n in enumerate(lengths):
        score = lambda p: starts[p[0]] + sum(e[i, t, x] for t, x in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(itertools.product(range(3), repeat=int(n)), key=score)
        assert tuple(got[i, :n]) == best and not got[i, n:].any()


def test_expected_counts_are_exact():
    r = np.random.default_rng(2)
    moves, starts = r.normal(size=(2, 2)), r.normal(size=2)
    e = r.normal(size=(2, 4, 2)).astype(np.float32)
    lengths = np.array([4, 2])
    marg, exp_moves, exp_starts = crf._expected(e, moves, starts, lengths)
    total = np.zeros((2, 2))
    assert exp_starts == pytest.approx(marg[:, 0].sum(axis=0), rel=1e-5)
    for i, n in enumerate(lengths):
        paths = list(itertools.product(range(2), repeat=int(n)))
        w = np.array([np.exp(starts[p[0]] + sum(e[i, t, x] for t, x in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        w /= w.sum()
        for t in range(n):
            assert marg[i, t, 1] == pytest.approx(sum(x for p, x in zip(paths, w) if p[t] == 1), rel=1e-4)
        for p, x in zip(paths, w):
            for a, b in zip(p, p[1:]):
                total[a, b] += x
    assert exp_moves == pytest.approx(total, rel=1e-4)


def test_decoding_only_where_something_is_possible_gives_the_same_labels():
    """Against decoding every sequence whole, with random scores: few, some and many entities."""
    r = np.random.default_rng(7)
    labels = ["O", "B-x", "I-x", "B-y", "I-y"]
    for shift in (-6.0, -2.5, -1.0, 0.5):
        moves, starts = crf.allowed_moves(labels)
        moves = moves + r.normal(size=moves.shape) * (moves == 0)
        starts = starts + r.normal(size=5) * (starts == 0)
        m = crf.Model(labels, 1, {}, np.zeros((1, 0, 4)), np.zeros((1, 1, 4)), moves, starts, [])
        lengths = [1, 2, 3, 40, 7, 200, 1]
        e = (r.normal(size=(sum(lengths) + crf.GAP * (len(lengths) + 1), 4)) * 2 + shift).astype(np.float32)
        outside = np.ones(len(e), bool)
        at, whole = crf.GAP, np.zeros(len(e), np.int64)
        for n in lengths:
            outside[at : at + n] = False
            one = np.zeros((1, n, 5), np.float32)
            one[0, :, 1:] = e[at : at + n]
            whole[at : at + n] = m.decode(one, np.array([n]))[0]
            at += n + crf.GAP
        assert (m.label(e, outside) == whole).all()


def test_hand_written_sentences(model):
    """Recall and precision of each type on sentences that share no frame with the labelled table."""
    from pii_heldout import sentences

    right, true, got_n = (dict.fromkeys(pii_labelled.TYPES, 0) for _ in range(3))
    cases = sentences()
    assert len(cases) > 200
    for (_, truth), found_ in zip(cases, pii.find(pii.Labeller(model), pa.array([t for t, _ in cases]))):
        got = {(t, p) for t, _, _, p in found_}
        for name, xs in ((true, truth), (got_n, got), (right, truth & got)):
            for t, _ in xs:
                name[t] += 1
    for t in pii_labelled.TYPES:
        assert right[t] >= 0.9 * true[t] and right[t] >= 0.9 * got_n[t], (t, right[t], true[t], got_n[t])


def test_frames_are_not_those_of_the_hand_written_sentences():
    """No stretch of six words of a frame, as filled in, occurs in them."""
    from pii_heldout import sentences

    f = pii_labelled.Filler(1, [])
    frames = [line for b in (*pii_labelled.FRAMES.values(), pii_labelled.DECOYS, pii_labelled.NUMBERS, pii_labelled.PLAIN) for line in pii_labelled.lines(b)]
    grams = lambda text: {tuple(w[i : i + 6]) for w in [text.lower().split()] for i in range(len(w) - 5)}
    known = {g for line in frames for _ in range(20) for piece in f.choose(line).split("{") for g in grams(piece)}
    assert not known & {g for t, _ in sentences() for g in grams(t)}


def test_other_names_and_numbers(model):
    """Passages of another seed, some of whose words are unknown ones."""
    right = wrong = missed = 0
    passages = pii_labelled.labelled(600, 99, [])
    texts = ["".join(p for p, _ in pieces) for pieces in passages]
    for pieces, found_ in zip(passages, pii.find(pii.Labeller(model), pa.array(texts))):
        truth = {(t, p) for p, t in pieces if t}
        got = {(t, p) for t, _, _, p in found_}
        right += len(truth & got)
        wrong += len(got - truth)
        missed += len(truth - got)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95


def found(model, text, given=frozenset()):
    return {(t, p) for t, _, _, p in pii.find(pii.Labeller(model, given), pa.array([text]))[0]}


def test_sentences(model):
    text = (
        "Inventor: Tilda Quorvenko\n\nHolder of identity card QK-1234-5678-90, as shown. Call +44-1632-960-321 before noon. "
        "Residing at 12 W. Marlow Street, Apt 4B, Dunby. Write to t.quorvenko [at] example.org for a copy. The sample (lot 123-45-6789) was dried."
    )
    assert found(model, text) == {
        ("person", "Tilda Quorvenko"),
        ("id_number", "QK-1234-5678-90"),
        ("phone", "+44-1632-960-321"),
        ("address", "12 W. Marlow Street, Apt 4B, Dunby"),
        ("email", "t.quorvenko [at] example.org"),
    }


def test_names_no_rule_would_look_for(model):
    for text, name in (("The concert was given by An Nguyen.", "An Nguyen"), ("We thank Ursula von der Leyen for the speech.", "Ursula von der Leyen"), ("Mein Name ist Klaus Meier.", "Klaus Meier"), ("The report was written by Maria Lopez in June.", "Maria Lopez")):
        assert ("person", name) in found(model, text)


def test_long_and_late(model):
    filler = "The rotor reaches 5 °C and the membrane is moved. " * 20_000
    assert found(model, filler + "Signed, Tilda Quorvenko") == {("person", "Tilda Quorvenko")}


def test_texts_longer_than_a_slice_and_many_in_one(model, monkeypatch):
    """Cut into overlapping pieces, a text gives the same entities as whole."""
    text = "".join(f"The pump turns {i} times. {'Signed, Tilda Quorvenko. ' if i % 37 == 0 else 'Call +44 1632 960321 before noon. ' if i % 41 == 0 else ''}" for i in range(400))
    labeller = pii.Labeller(model)
    whole = pii.find(labeller, pa.array([text, None, "", text]))
    assert whole[0] == whole[3] and not whole[1] and not whole[2] and len(whole[0]) == 11 + 9
    monkeypatch.setattr(pii, "SLICE", 3000)
    monkeypatch.setattr(pii, "OVERLAP", 800)
    assert pii.find(labeller, pa.array([text]))[0] == whole[0]


def test_tokens_are_those_of_the_text():
    texts = ["Write to a@b.org\n\nnow", "", "x", "ünd Ïm 12 Äo e\u0301 \U0001f600", "٣٤ 030-1"]
    points, starts = pii.tokens.laid_out(texts)
    t = pii.tokenize(points, starts)
    whole = "".join(texts)
    got = [[whole[a:b] for a, b, i in zip(t.begin, t.end, t.text) if i == k] for k in range(len(texts))]
    assert got == [["Write", "to", "a", "@", "b", ".", "org", "\n\n", "now"], [], ["x"], ["ünd", "Ïm", "12", "Äo", "e\u0301", "\U0001f600"], ["٣٤", "030", "-", "1"]]
    same = [h for a, b, h in zip(t.begin, t.end, t.hashed) if whole[a:b] == "-"]
    assert len(set(same)) == 1 and len(set(t.hashed.tolist())) == len({whole[a:b] for a, b in zip(t.begin, t.end)})


def test_model_is_kept(spark, model, tmp_path):
    assert pii.load_model(spark, str(tmp_path / "none")) is None
    pii.save_model(spark, model, str(tmp_path / "m"))
    got = pii.load_model(spark, str(tmp_path / "m"))
    text = "Dear Tilda Quorvenko, call 030 1234567 or write to a.b@c.org."
    assert found(got, text) == found(model, text) and got.features == model.features and got.extra == model.extra


def test_find_and_redact(spark, model):
    docs = [(1, "Signed, Tilda Quorvenko. Tel. 01632 960123", "a"), (2, None, None), (3, "", "b"), (4, "\U0001f600 ß Signed, Tilda Quorvenko", ""), (5, "no one", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, pii_type string")
    texts = {d: t for d, t, _ in docs}
    for r in pii.find_pii(df, ["doc_id"], "text", model=model).collect():
        assert texts[r["doc_id"]][r["pii_start"] : r["pii_end"]] == r["pii_text"]
    got = {r["doc_id"]: (r["redacted"], r["n_found"]) for r in pii.redact(df, ["doc_id"], "text", model=model).collect()}
    assert got[1] == ("Signed, [PERSON]. Tel. [PHONE]", 2) and got[2] == (None, 0) and got[3] == ("", 0) and got[5] == ("no one", 0)
    assert got[4] == ("\U0001f600 ß Signed, [PERSON]", 1)
    assert pii.find_pii(df.limit(0), ["doc_id"], "text", model=model).count() == 0


def test_checked():
    assert pii.checked("email", "<a@b.org>.") == (1, 8)
    assert pii.checked("email", "a@b") is None and pii.checked("phone", "123") is None and pii.checked("person", "Quorvenko") is None
    assert pii.checked("phone", "(030) 1234567)") == (0, 13) and pii.checked("phone", "(030 1234567)") == (1, 12)
    assert pii.checked("address", "in the long run") is None and pii.checked("person", "Quorvenko, T.") == (0, 13)


def test_labelled_table_is_the_same_each_time():
    assert pii_labelled.labelled(20, 3, ["A"]) == pii_labelled.labelled(20, 3, ["A"])
