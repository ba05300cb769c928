r"""Documents that are template residue, filler, error pages or script notices instead of content.

Character n-gram models are fitted: one of natural prose, on all documents, and one each of filler, of error notices and of
script notices, on the sentences of ``residue_seeds``. Every n-gram then has a log-likelihood ratio (the best of the residue models against
prose). Windows whose mean ratio is positive localise residue, and a document is excluded when they cover enough of what is written
in it outside quotation. Blanks never filled in are localised by their form: outside code and quotation even one of them excludes a document.

Corpus counts lie in a fixed number of hash slots and are used as shares of all n-grams only: other n-grams add to a slot's share less than
2 / SLOTS on average whatever the size of the corpus, far below the shares that make an n-gram count as prose (COMMON), so
ratios are alike at every size. The threshold was set on pages and texts held out of the fit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.residue_seeds import ERRORS, FILLER, HELD_OUT_PROSE, HELD_OUT_RESIDUE, PROSE, REASONS, SCRIPTS

N = 5
SLOTS = 1 << 20
WINDOW = 24
#: Share of a text in windows of residue from which it is excluded: set between the coverages of held-out pages (see ``held_out``).
COVERAGE = 0.47
#: Share of all n-grams from which one that no residue model has speaks for prose; below it, it says little (RARE).
COMMON = 1e-6
RARE = 0.5
#: Least share in prose that any n-gram is given, so that a single occurrence in a residue model isn't strong evidence.
PRIOR = 5e-6
#: Known n-grams in a row that make a text one to learn filler from, and the log ratio from which an n-gram is learned.
RUN = 18
LEARNED = 3.0

# Forms of blanks in templates, of any length; each form ends where its opening sign could begin again, so a search takes linear time.
BLANKS = re.compile(
    r"\{\{[^{}\n]+\}\}|\$\{[^{}\n]+\}|<%=?[^%<>\n]+%>|\[\[[^\[\]\n]+\]\]|<<[^<>\n]+>>|%\([A-Za-z_ ]+\)[sd]|(?<!\w)__[A-Z](?:_?[A-Z0-9])*__(?!\w)|@@[A-Za-z][\w ]*@@|(?<![\w$])\$[A-Z][A-Z0-9_]+\$|(?<![\w{$%])\{[A-Za-z][\w ]*\}(?!\})|\{%[^%{}\n]+%\}"
    r"|\[(?:INSERT|INSÉRER|INSERTAR|INSERTE|INSERER|HIER|EINFÜGEN|YOUR|ENTER|FILL IN|AQUÍ|PONER|ESCRIBA|TODO|TBD)\b[^\[\]\n]*\]"
)
# Code and quotation, in which blanks are shown rather than left.
_SHOWN = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|(?m:^(?: {4,}|\t)[^\n]*)|\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]", re.S)


#: Quotation of a few words within a line: a text that quotes a notice reports on it.
_QUOTED = re.compile(r"`[^`\n]*`|\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]")


def has_blank(text: str) -> bool:
    """Whether a template blank stands outside code and quotation."""
    if not any(c in text for c in ("{", "<%", "<<", "[", "%(", "__", "@@", "$")) or not BLANKS.search(text):
        return False
    return BLANKS.search(_SHOWN.sub(lambda m: " " * len(m[0]), text)) is not None


#: Kinds of characters: 1 digits, 2 white space, 0 others; runs of digits or white space count as one.
_KINDS = np.array([1 if chr(c).isdigit() else 2 if chr(c).isspace() else 0 for c in range(0x3002)], np.uint8)
_KINDS[-1] = 0


def _slots(text: str) -> np.ndarray:
    """Hash slots of the text's n-grams (digits as one, letter case and runs of white space dropped)."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _KINDS[np.minimum(codes, len(_KINDS) - 1)]
    codes = np.where(kind == 1, 48, np.where(kind == 2, 32, codes))
    if len(codes):
        codes = codes[np.concatenate([[True], (kind[1:] == 0) | (kind[1:] != kind[:-1])])]
    codes = codes.astype(np.uint64)
    if len(codes) < N:
        codes = np.pad(codes, (0, N - len(codes)), constant_values=32)
    h = np.zeros(len(codes) - N + 1, np.uint64)
    for i in range(N):
        h = h * np.uint64(0x100000001B3) + codes[i : len(codes) - N + 1 + i]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _seeded() -> np.ndarray:
    """Slots of the n-grams of the known filler sentences."""
    known = np.zeros(SLOTS, bool)
    for line in FILLER.strip().splitlines():
        known[_slots(line)] = True
    return known


def _runs(slots: np.ndarray, known: np.ndarray) -> bool:
    """Whether RUN n-grams in a row are known filler."""
    hits = np.concatenate([[0], np.cumsum(known[slots])])
    return len(hits) > RUN and bool((hits[RUN:] - hits[:-RUN] == RUN).any())


def corpus_counts(df: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts by slot of all texts, and of those with a run of known filler in them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, filler = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        known = _seeded()
        for b in batches:
            slots = [_slots(t) for t in b.column(0).to_pylist()]
            every += np.bincount(np.concatenate(slots), minlength=SLOTS)
            for s in slots:
                if _runs(s, known):
                    filler += np.bincount(s, minlength=SLOTS)
        at = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(every[at]), pa.array(filler[at])], names=["slot", "n", "f"])

    rows = df.where(f"`{text}` is not null").select(text).mapInArrow(count, "slot long, n long, f long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("f").alias("f")).toArrow()
    every, filler = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
    every[rows["slot"].to_numpy()], filler[rows["slot"].to_numpy()] = rows["n"].to_numpy(), rows["f"].to_numpy()
    return every, filler


def ratios(every: np.ndarray, filler: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of every slot: the best of the residue models against prose, between -6 and 6.

    Where no residue model has the n-gram it is -6 for the commonest n-grams of prose, and nears -RARE as they get rarer. The prose
    sentences of ``residue_seeds`` count as half of the prose where the corpus has less of an n-gram. The filler model is also fitted on the corpus: texts with a run of known filler hold other filler of
    the same making, whose n-grams are many times as likely there as in the other texts.
    """
    total = max(int(every.sum()), 1)
    share = (every + 0.5) / (total + 0.5 * SLOTS)
    known = sum(np.bincount(_slots(line), minlength=SLOTS) for line in PROSE.strip().splitlines())
    share = np.maximum(share, known / (2 * known.sum()))
    likely = np.maximum(share, PRIOR)
    best = np.clip(np.log(COMMON / share) - RARE, -6, -RARE)
    for seed in (FILLER, REASONS + ERRORS, SCRIPTS):
        counts = sum(np.bincount(_slots(line), minlength=SLOTS) for line in seed.strip().splitlines())
        with np.errstate(divide="ignore"):
            best = np.maximum(best, np.clip(np.log(counts / counts.sum() / likely), -6, 6))
    others = every - filler
    learned = np.log((filler + 0.1) / max(int(filler.sum()), 1)) - np.log((others + 0.5) / max(int(others.sum()), 1))
    adopted = (filler >= 3) & (learned > LEARNED)
    best[adopted] = np.maximum(best[adopted], np.clip(learned[adopted], 0, 6))
    return best.astype(np.float32)


def coverage(text: str, ratio: np.ndarray) -> float:
    """Share of the text outside quotation that lies in windows of residue; 0 for a blank text."""
    if any(c in text for c in "`\"“«„"):
        text = _QUOTED.sub(" ", text)
    if not text.strip():
        return 0.0
    r = ratio[_slots(text)]
    w = min(WINDOW, len(r))
    upto = np.concatenate([[0.0], np.cumsum(r, dtype=np.float64)])
    at = np.flatnonzero(upto[w:] - upto[:-w] > 1e-9)
    hit = np.zeros(len(r) + 1, np.int32)
    hit[at] += 1
    hit[at + w] -= 1
    return float((np.cumsum(hit[:-1]) > 0).mean())


def held_out(ratio: np.ndarray) -> tuple[list[float], list[float]]:
    """Coverages of the held-out pages, and of the held-out ordinary texts."""
    pages, texts = ([coverage(line, ratio) for line in part.strip().splitlines()] for part in (HELD_OUT_RESIDUE, HELD_OUT_PROSE))
    return pages, texts


def judged(df: DataFrame, ident: str, text: str, models_from: DataFrame | None = None) -> DataFrame:
    """(ident, blank, coverage, residue) of every document.

    Null, empty and white-space texts are no residue (coverage 0). Texts are taken whole; repeated rows are judged each. The prose model is fitted
    on all texts of ``models_from``, by default ``df``.
    """
    ratio = df.sparkSession.sparkContext.broadcast(ratios(*corpus_counts(models_from if models_from is not None else df, text)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            blank = [has_blank(t) for t in texts]
            cover = [coverage(t, ratio.value) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(blank), pa.array(cover, pa.float64()), pa.array([x or c >= COVERAGE for x, c in zip(blank, cover, strict=True)])], names=[ident, "blank", "coverage", "residue"])

    kind = df.schema[ident].dataType.simpleString()
    return df.select(ident, text).mapInArrow(judge, f"`{ident}` {kind}, blank boolean, coverage double, residue boolean")
