from pathlib import Path

import pytest

from lumenlog.llm import residue_seeds as seeds
from lumenlog.llm.residue import COVERAGE, corpus_counts, has_blank, held_out, judged, ratios

DOCUMENTS = "/root/testdata/sf0.1/documents.parquet"
PROSE = "The {0} service on db0{1} went stale after {1} minutes and the operators noticed a rise of queue messages. A new model was trained on {1}0 days of data, leaving out the outage of {0}. Check that the clocks agree before comparing their intervals."
RESIDUE = {
    1: "404 Not Found\nThe server could not complete the request.", 2: "Please enable JavaScript to view this page.", 3: "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore.",
    4: "Dear {{ first_name }}, the maintenance is over. " + PROSE.format("vault", 3), 5: "Hello\n    Jan 3 10:00:00 log line\nContact %(owner)s before the restart.", 6: "Seite nicht gefunden. Die angeforderte Seite wurde nicht gefunden.",
    7: "Lorem ipsum dolor sit amet vomax tirel vomax brumo sandek tirel brumo sandek vomax tirel brumo sandek vomax tirel vomax brumo sandek tirel brumo.", 8: "Vomax tirel sandek brumo tirel vomax brumo sandek vomax tirel brumo sandek vomax tirel.",
}
REAL = {
    20: "The template shows `{{ first_name }}`, filled in before the mail is sent. " + PROSE.format("mail", 4), 21: 'Users reported "page not found" for the old link. ' + PROSE.format("router", 5), 22: PROSE.format("ledger", 6), 23: "", 24: None, 25: " \n\t", 26: "The format string \"%(x)s\" was wrong. " + PROSE.format("quota", 7),
    27: "Run this:\n```\necho ${HOST}\n```\nand check. " + PROSE.format("spool", 2),
}


def test_judged(spark):
    fill = [(100 + i, PROSE.format(s, i % 9 + 1)) for i, s in enumerate(["vault", "mail", "router", "ledger", "quota", "spool"] * 60)]
    rows = [*RESIDUE.items(), *REAL.items(), *fill, (1, RESIDUE[1])] + [(1000 + i, RESIDUE[7]) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as residue", "2 as coverage")
    got = judged(df, "doc_id", "text").collect()
    assert len(got) == len(rows)
    found = {r["doc_id"] for r in got if r["residue"]}
    assert found == set(RESIDUE) | {1000, 1001, 1002}
    assert judged(df.limit(0), "doc_id", "text").count() == 0


def test_blanks():
    for t in ("{{x}}", "${y}", "<%= z %>", "[[name]]", "<<HOST>>", "__OWNER__", "@@date@@", "$CONTACT$", "{customer}", "[INSERT NAME HERE]", "[HIER NAME EINTRAGEN]", "[INSÉRER CONTACT ICI]"):
        assert has_blank(f"Dear {t}, hello") and not has_blank(f"the code `{t}` is shown") and not has_blank(f'it says "{t} lost" there')
    for t in ("{{" + "x" * 5000 + "}}", "${" + "y " * 300 + "}", "__" + "A_" * 200 + "A__", "[INSERT " + "the name " * 100 + "]"):
        assert has_blank(f"Dear {t}, hello")
    for t in ("{{x" * 40_000, "__A" * 60_000, "@@" * 60_000, "$A " * 60_000, "[[a" * 60_000, "%(a" * 60_000, "<<" * 60_000):
        assert not has_blank(t)  # in linear time
    assert not has_blank("dict {1: 2} and a[0][1] and __init__ and $5 and 10% (a)s") and not has_blank("x" * 200_000)


@pytest.mark.skipif(not Path(DOCUMENTS).exists(), reason="needs a corpus of documents")
def test_held_out_pages(spark):
    """Models fitted on a corpus of documents and the seeds; nothing is fitted on these pages and texts."""
    pages, texts = held_out(ratios(*corpus_counts(spark.read.parquet(DOCUMENTS), "text")))
    found, wrong = sum(c >= COVERAGE for c in pages), sum(c >= COVERAGE for c in texts)
    assert found / len(pages) >= 0.95 and found / (found + wrong) >= 0.85
    known = {s.strip().lower() for part in (seeds.FILLER, seeds.ERRORS, seeds.SCRIPTS) for s in part.replace("\n", ". ").split(". ")}
    assert not (known - {""}) & {s.strip(". ").lower() for line in seeds.HELD_OUT_RESIDUE.splitlines() for s in line.split(". ")}
