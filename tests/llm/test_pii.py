import random

import numpy as np
from pyspark.sql import functions as F

from lumenlog.llm.pii import CUES, NUMBERS, STREET, Model, _plain, can_mention, features, find_mentions, mentions, redact, skips, tokens
from lumenlog.llm.pii_train import GIVEN, HELD_OUT, TEMPLATES, report

GIVEN_SET = frozenset(_plain(g) for g in GIVEN)


def test_templates_held_out():
    """Precision and recall of every kind on sentences whose templates were not trained on."""
    assert not set(TEMPLATES) & set(HELD_OUT)
    got = report(Model.load())
    assert len(got) == 5 and all(p > 0.95 and r > 0.95 for p, r in got.values()), got


def test_numbers_named_in_other_words():
    texts = {
        "ssn on file: 123456789 confirmed": [("id_number", "123456789")], "the ssn of the caller is 123456789": [("id_number", "123456789")], "passport number:\n123456789": [("id_number", "123456789")],
        "steuer-id 12345678901 gemeldet": [("id_number", "12345678901")], "call 415 555 2671 or 0301234567890 please": [("phone", "415 555"), ("phone", "03012")],
    }
    got = mentions(list(texts), Model.load(), GIVEN_SET)
    assert [[(k, s) for k, s, _ in g] for g in got] == [[(k, t.index(w)) for k, w in want] for t, want in texts.items()]


def test_trigger_loses_no_text_with_a_token_that_can_be_labelled(spark):
    """Texts of random pieces: whenever a token may have another label than O, the filter before the field keeps the text."""
    r = random.Random(11)
    pieces = ["Anna", "KOCH", "É.", "J.", "ßtraße", "Lindenstraße", "Rue", "rue", "St", "via", "Drive", "12", "3 b", "3.º", "a@b.c", "a [at] b.c", "(at)", "+1 2 3", "+", ",", ".", "-", "/", "(", ")", "123", "4567", "12 34", "123456789", "QQ", "C", "C/ ", "\u00a0", "\u2003", "\u2028", "\x1c", "\t", "\n", " ", " ", "\u0661\u0662\u0663", "Ⅷ", "ǅ", "é", "_", "'", "x9", "0", "555", "0192"]
    texts = ["".join(r.choice(pieces) + r.choice(["", " ", " "]) for _ in range(r.randint(1, 6))) for _ in range(6000)]
    can = [any(f and not (f[-1] == f"s={f[0][2:]} name=False address=False" and f[0][2:] not in ("email", "plus", *NUMBERS)) for f in features(tokens(t, GIVEN_SET))) for t in texts]
    kept = {x["i"] for x in spark.createDataFrame(list(enumerate(texts)), "i long, text string").where(can_mention(F.col("text"))).collect()}
    assert sum(can) > 1000 and [t for i, t in enumerate(texts) if can[i] and i not in kept] == []


def test_long_texts_are_labelled_in_bounded_batches():
    long = "value 12 of Anna Koch " * 30_000
    got = mentions([long, *["mail from Anna Koch"] * 500], Model.load(), GIVEN_SET)
    assert len(got[0]) == 30_000 and all(len(g) == 1 for g in got[1:])


def test_messages_over_skip_edges_settle():
    model = Model.load()
    r = np.random.default_rng(3)
    batch = [(r.normal(size=(12, 8)).astype(np.float32), [(0, 5), (5, 9), (1, 9), (0, 9)]) for _ in range(20)]
    together = model.decode(batch)
    assert all((a == model.decode([b])[0]).all() for a, b in zip(together, batch, strict=True))


def test_cues_are_no_sentences():
    assert all(w.isalpha() for words in CUES.values() for w in words.split()) and "avenue" in STREET


def test_find_and_redact(spark):
    rows = [
        (1, "ticket 895140455 escalated, customer Yorunn Torvessen waits at +1 212 555 0192"), (2, "profile export: Steningham, Sofia | 1696 Hollowby St. | +49 30 23125 242 | sofia.steningham@corp.test"),
        (3, "NINO QQ 65 83 43 C stored in /etc/agent.d/x.log"), (4, "git remote deploy@app01 answered in 12 ms"), (5, "Release Candidate 2.8.0 tagged on rack12"), (6, None), (7, ""), (8, "vpn login of Dr. Julia Lindvessen from 192.0.2.13 took 5 ms"),
        (9, "x" * 100_000 + " mailto:andre54@post.invalid opened by agent 1.2.3"), (9, "mailto:andre54@post.invalid opened by agent 1.2.3"),
    ]
    names = spark.createDataFrame([("Sofia",), ("Julia",), (None,), ("Sofia",)], "name string")
    df = spark.createDataFrame(rows, "i long, text string").selectExpr("*", "'c' as kind", "1 as start_pos")
    got = sorted((r["i"], r["kind"], r["start_pos"]) for r in find_mentions(df, "i", "text", names).collect())
    wanted = {1: [("name", "Yorunn"), ("phone", "+1")], 2: [("name", "Stening"), ("street_address", "1696"), ("phone", "+49"), ("email", "sofia.")], 3: [("id_number", "QQ")], 8: [("name", "Julia")], 9: [("email", "andre54")]}
    assert got == sorted((i, k, t.index(w) + 1) for i, t in rows for k, w in wanted.get(i, []))
    text = {r["i"]: r["redacted"] for r in redact(df, "text", names).collect()}
    assert text[2] == "profile export: [name] | [street_address] | [phone] | [email]" and text[6] is None and text[7] == "" and text[4] == rows[3][1]
    assert find_mentions(df.limit(0), "i", "text", names).count() == 0 and find_mentions(df, "i", "text").count() > 5


def test_words_are_tied_to_every_address_that_holds_them():
    toks = [(shape, text, 0, 0) for shape, text in [("email", "first.person@a.example"), ("email", "maria.koch@b.example"), ("email", "koch.office@c.example"), ("cap", "Maria"), ("cap", "Koch"), ("cap", "Person"), ("cap", "Other")]]
    assert sorted(skips(toks)) == [(3, 1), (4, 1), (4, 2), (5, 0)]
