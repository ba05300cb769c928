r"""Personal information in free text by a skip-chain conditional random field.

A text is cut into tokens: words, numbers, punctuation, and whole strings of the shape of an e-mail address, a
phone number or an identity number (a shape alone is only evidence: a firmware version can look like a phone number).
The field labels tokens. Its potentials are sums of trained weights of a token's shape and those around it, and of the kinds of words near it
(words that name an identity number, a telephone, a person, a place, a machine's number; no sentence is learned by its words); of neighbouring
labels; and of skip edges, which tie tokens of the same spelling, and words to e-mail addresses that contain them, however far apart they
are. The labelling is found by loopy max-product message passing: exact passes along the chains of a batch of texts at once alternate
with damped messages over the skip edges until the messages stay the same (at most ROUNDS times).

What a mention must have is fixed: a name is two words or initials in capitals in a row, an address has a street word and a number, and plain digits are a
person's number only where the text names such a number or holds another possible mention. So a text
without them (see ``can_mention``, made of the tokens' own patterns) has no token that can be labelled, and is left out before. The
weights are trained by ``pii_train`` on generated labelled sentences and lie in pii_weights.json.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("O", "E", "P", "I", "BN", "IN", "BA", "IA")
KINDS = {"E": "email", "P": "phone", "I": "id_number", "BN": "name", "BA": "street_address"}
#: Labels by class: a skip edge is content where both ends are of one class.
CLASS = np.array([0, 1, 2, 3, 4, 4, 5, 5])
#: Most rounds of messages over the skip edges, and the change below which they count as settled.
ROUNDS, SETTLED = 40, 1e-3
#: Tokens of a batch that is labelled at once, padding included.
BATCH_TOKENS = 131_072

# Words of streets and dwellings, titles, words that say what a number, a name or an address near them is, and capitalised words that are no names.
STREET = frozenset("st street avenue ave road rd blvd boulevard lane ln drive dr court ct square sq way place pl terrace rue calle avenida av via platz allee chemin impasse plaza paseo".split())
FLAT = frozenset("flat apt apartment unit suite".split())
TITLES = frozenset("dr mr mrs ms miss prof herr frau sr sra mme".split())
CUES = {
    "id": "ssn social security sin national identity identification passport passeport pasaporte insurance tax taxpayer tin nino dni nif nie ausweis personalausweis ausweisnummer reisepass steuer steuernummer steueridentifikationsnummer sozialversicherung sozialversicherungsnummer versicherungsnummer fiscal fiscale sécurité identité seguridad identidad citizen civil curp",
    "phone": "phone telephone tel mobile mob cell fax call calls called calling callback dial dials dialled dialed sms texted text ring hotline landline msisdn whatsapp reach reachable telefon telefonnummer rufnummer handy anruf mobil téléphone portable appeler teléfono móvil llamar",
    "thing": "bytes byte kb mb gb batch sector sectors disk serial order part request requests job jobs pid error errors count counter port ms sec seconds epoch account build firmware version block blocks offset seq sequence uuid trace transaction invoice entries entry record records case rows lines size code key device sensor lane bus inode checksum hash timestamp packet packets frame fault volume shelf lun segment index page pages process thread worker kernel cache item items sku asset bug commit lease slot instance node revision read written finished loaded zip retry epochs",
    "person": "by user holder contact contacts customer client attn attention ask asks asked hello hi dear belongs owner owned resident employee patient caller name names named approved requested issued signed assigned reported manager operator engineer author colleague guest visitor member reviewed granted revoked thanks regards supervisor technician handed signer applicant tenant subscriber recipient sender person dr kollege mitarbeiter benutzer kunde kundin usuario cliente client employé",
    "place": "lives living resident residence address addr home delivery deliver delivered ship shipped shipping parcel courier goes visit located premises moved wohnhaft anschrift adresse domicile dirección domicilio",
}
NOT_NAMES = frozenset("amber silver golden gold copper iron azure crimson scarlet emerald cobalt bronze indigo violet falcon heron otter badger lynx raven eagle wolf tiger panther condor central european western eastern northern southern atlantic pacific release candidate build version status error warning notice queue cluster primary secondary backup summer winter spring autumn standard daylight saving time access denied night day shift late early data center centre network service server system disk memory process request response internal external general monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december the this that a an on in at to of for from no not and or is was were be been job task user home page open closed start stop end read write send received".split())
_CUE = {w: c for c, words in reversed(CUES.items()) for w in words.split()}
_STREET_END = re.compile(r"(?:straße|strasse|str|gasse|weg|platz|allee|ufer|damm|ring)$")

# Shapes of telephone and identity numbers, tried in this order; digits are those of any script.
NUMBERS = {
    "paren": r"\(\d{2,4}\)[ ]?\d{3,4}[- ]\d{3,4}(?![\w-])",
    "phone": r"(?<![\w./-])(?:00\d-\d{3}-\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|\d{3}[ ]\d{3}[ ]\d{4}|0\d{2}[ ]\d{4}[ ]\d{4}|0\d(?:[. ]\d\d){4}|0\d{2,4}/\d{4,6}-\d{2,4})(?![\w/-])",
    "dotted": r"(?<![\w./-])\d{3}\.\d{3}\.\d{4}(?![\w./-])",
    "nine": r"(?<![\w./-])(?:\d{3}-\d{2}-\d{4}|\d{3}[ ]\d{2}[ ]\d{4})(?![\w/-])",
    "nino": r"(?<![\w./-])[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D](?!\w)",
    "dni": r"(?<![\w./-])\d{8}-?[A-Z](?!\w)",
    "pass": r"(?<![\w./-])[A-Z]\d{2}[ ]?\d{6}(?!\w)",
    "tax": r"(?<![\w./-])(?:\d{2}[ ]\d{3}[ ]\d{3}[ ]\d{3}|\d{2}/\d{3}/\d{5})(?![\w/-])",
    "d10": r"(?<![\w./-])\d{10}(?![\w/-])",
    "d11": r"(?<![\w./-])\d{11}(?![\w/-])",
    "d12": r"(?<![\w./-])\d{12,14}(?![\w/-])",
    "d9": r"(?<![\w./-])\d{9}(?![\w/-])",
}
#: Digits without a sign between them: they can be anything, so they count only where the text names such a number, or a person or address.
PLAIN_DIGITS = ("d9", "d10", "d11", "d12")
_PLUS = r"\+\d{1,3}(?:[ .-]?(?:\(\d{1,4}\)|\d{1,8})){2,6}(?![\w-])"

_TOKEN = re.compile(
    r"""
    (?P<email>[\w.+%-]+@[\w-]+(?:\.[\w-]+)+|[\w.+%-]+\s?[\[(]at[\])]\s?[\w-]+(?:(?:\s?[\[(]dot[\])]\s?|\.)[\w-]+)+)
    |(?P<path>(?<![\w.])/[\w./-]+)
    |(?P<plus>"""
    + _PLUS
    + r""")
    |(?P<ip>(?<![\w.-])\d{1,3}(?:\.\d{1,3}){3}(?![\w.-]))
    |"""
    + "\n    |".join(f"(?P<{k}>{v})" for k, v in NUMBERS.items())
    + r"""
    |(?P<floor>(?<![\w./-])\d{1,2}\.?[ºª°](?:[ ]?[A-Z]\b)?)
    |(?P<calle>\bC/(?=[ ]))
    |(?P<house>(?<![\w./:-])\d{1,4}[ ]?[a-z]?(?![\w./-]|:\w))
    |(?P<mixed>\w*\d[\w.:@-]*\w|[\w.-]+@[\w-]+)
    |(?P<initial>\b[^\W\d_a-z]\.(?=[ ]))
    |(?P<word>[^\W\d_]+(?:['’-][^\W\d_]+)*)
    |(?P<punct>[^\s\w])
    |(?P<other>\S)
    """,
    re.X,
)

_SPACE = r"[\s\p{Z},\x1c-\x1f\x85]"
_IN_WORD = r"(?<![\p{L}&&[^ºª]])"


def _street_words() -> str:
    """Street words in capitals (and the three that count in small letters), by their first letters."""
    tails: dict[str, list[str]] = defaultdict(list)
    for word in sorted(STREET):
        tails[word[0].upper()].append(word[1:])
    return "|".join(["rue", "avenue", "calle", *[f"{first}(?i:{'|'.join(rest)})" for first, rest in tails.items()]])


#: What a text with a mention holds, from the tokens' own patterns, the cheap conditions first; each is anchored where its token begins, so a search takes
#: linear time. An address with @ or [at], or an international number; a word with a capital and, after white space or a comma, another capital.
_MAIL_OR_PLUS = r"@|[\[(]at[\])]|\+\p{Nd}"
_NAME = rf"(?:^|{_SPACE})[^\s\p{{Z}},\x1c-\x1f\x85\p{{IsUppercase}}]*+\p{{IsUppercase}}[^\s\p{{Z}},\x1c-\x1f\x85]*+{_SPACE}++\p{{IsUppercase}}"
#: A number of a known shape; all shapes have six digits with at most one other sign between two of them.
_SIX_DIGITS = r"\p{Nd}(?:[ ./()-]{0,2}+\p{Nd}){5}"
_NUMBER = "|".join(v.replace(r"\d", r"\p{Nd}") for k, v in NUMBERS.items() if k not in PLAIN_DIGITS)
_DIGITS = r"(?<![\w./-])\p{Nd}{9,14}(?![\w/-])"
_NAMED = rf"(?iu)(?<!\p{{L}})(?:{'|'.join(sorted((CUES['id'] + ' ' + CUES['phone']).split()))})(?!\p{{L}})"
#: A street word, alone or at the end of a capitalised word.
_STREET = rf"{_IN_WORD}(?:{_street_words()})(?!\p{{L}})|{_IN_WORD}\p{{IsUppercase}}\p{{L}}*?(?i:stra(?:ß|ss)e|str|gasse|weg|platz|allee|ufer|damm|ring)(?!\p{{L}})|\bC/"


def can_mention(text: Column) -> Column:
    """Whether a text holds a token that can have a label; null for a null text."""
    digits = text.rlike(_SIX_DIGITS) & (text.rlike(_NUMBER) | (text.rlike(_DIGITS) & text.rlike(_NAMED)))
    return text.rlike(_MAIL_OR_PLUS) | text.rlike(_NAME) | digits | (text.rlike(r"\p{Nd}") & text.rlike(_STREET))


#: Labels that a shape can have at all: only addresses are E, only numbers P or I; names begin with words, addresses with numbers or street words.
_ONLY = {"email": (1,)}


@functools.lru_cache(maxsize=1000)
def _allowed(shape: str) -> tuple[int, ...]:
    """Numbers of the labels besides O."""
    if shape in _ONLY:
        return _ONLY[shape]
    if shape in _NUMBERS:
        return (2, 3)
    if shape in _WORDY:
        return (4, 5, 7)
    if shape in _STREETY:
        return (6, 7)
    return (5, 7)


def _possible(shapes: list[str]) -> list[tuple[bool, bool]]:
    """Whether a name can begin at each token (a word in capitals follows, or a comma and such a word), and whether the text can hold an address."""
    n, address = len(shapes), any(s in _STREETS for s in shapes) and any(s in ("house", "floor") for s in shapes)
    wordy = [s in _WORDY for s in shapes]
    name = [wordy[i] and i + 1 < n and (wordy[i + 1] or (shapes[i + 1] == "," and i + 2 < n and wordy[i + 2])) for i in range(n)]
    return [(x, address) for x in name]


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if c.isalpha())


@functools.lru_cache(maxsize=200_000)
def _shape(kind: str, token: str, given: frozenset[str]) -> str:
    """The token's class: its kind, and for words their case and what lists say of them."""
    if kind == "initial" and not token[0].isupper():
        return "low"
    if kind != "word":
        return kind if kind != "punct" else token
    low = token.lower()
    if token[0].isupper():
        if low in FLAT:
            return "flat"
        if low in STREET:
            return "street"
        if _STREET_END.search(low) and len(low) > 6:
            return "streetword"
        if low in TITLES:
            return "title"
        if any(p in given for p in _plain(token.split("-")[0].split("’")[0]).split()):
            return "given"
        if len(token) == 1:
            return "letter"
        if low in NOT_NAMES or low in _CUE:
            return "plainword"
        if token.isupper():
            return "upper"
        return "cap"
    if low in ("rue", "avenue", "calle"):
        return "street"
    return "low"


def tokens(text: str, given: frozenset[str]) -> list[tuple[str, str, int, int]]:
    """(shape, lower-cased text, start, end) of every token."""
    out: list[tuple[str, str, int, int]] = []
    at = 0
    while at < len(text):
        begun = at
        at = len(text)
        for m in _TOKEN.finditer(text, begun):
            kind, token = m.lastgroup, m[0]
            if kind == "plus" and (cut := _number_end(token)) < len(token):
                out.append((kind, token[:cut], m.start(), m.start() + cut))
                at = m.start() + cut
                break
            out.append((_shape(kind, token, given), token.lower(), m.start(), m.end()))
    return out


def _number_end(token: str) -> int:
    """Where an international number ends: a group of digits beyond the most that numbers have belongs to what follows."""
    most = 11 if token.startswith(("+1", "+33")) else 13
    end, digits = 0, 0
    for g in re.finditer(r"\d+\)?", token):
        digits += sum(c.isdigit() for c in g[0]) - (g[0] == "0)")
        if digits > most:
            return end
        end = g.end()
    return len(token)


_WORDY = frozenset(("given", "cap", "upper", "initial", "letter", "plainword"))
_NUMBERS = frozenset(("plus", *NUMBERS))
_SURE = frozenset(("email", "plus", *[k for k in NUMBERS if k not in PLAIN_DIGITS]))
_STREETS = frozenset(("street", "streetword", "calle"))
_STREETY = frozenset(("street", "streetword", "calle", "flat", "house", "floor"))
_MENTION = frozenset(("email",)) | _WORDY | _NUMBERS | _STREETY


def features(toks: list[tuple[str, str, int, int]]) -> list[list[str]]:
    """Names of the features that are on at each token; none where the token can only be O.

    Words count by their shape and the kind of cue they are, never by their spelling."""
    n = len(toks)
    cue = [next((_CUE[w] for w in t[1].split("-") if w in _CUE), None) if t[0] not in ("given", "email") else None for t in toks]
    shapes = ["^^", "^"] + [f"low:{c}" if c and t[0] == "low" else t[0] for t, c in zip(toks, cue, strict=True)] + ["$", "$$", "$$$"]
    plain = [t[0] for t in toks]
    can = _possible(plain)
    named = any(c in ("id", "phone") for c in cue) or any(name or address for name, address in can) or any(s in _SURE for s in plain)
    out: list[list[str]] = []
    heard: list[tuple[int, str]] = []  # cues so far: word number, kind
    words = 0
    for i in range(n):
        s, (name, address) = plain[i], can[i]
        before = plain[i - 1] if i else "^"
        inside = before in _MENTION and s in (",", "low", ".", "º", "mixed", "punct")
        if s in _SURE or (named and s in PLAIN_DIGITS) or name or (s in _WORDY and (before in _WORDY or before == "," or address)) or (address and (s in _STREETY or inside)) or (inside and before in _WORDY and s == ","):
            p1, p2, n1, n2, n3 = shapes[i + 1], shapes[i], shapes[i + 3], shapes[i + 4], shapes[i + 5]
            f = [f"s={s}", f"s={s} p={p1}", f"s={s} n={n1}", f"s={s} p={p1} n={n1}", f"s={s} n={n1},{n2}", f"s={s} n={n1},{n2},{n3}", f"s={s} p={p2},{p1}"]
            near = [(c, words - at) for at, c in heard if words - at < 6]
            f += [f"s={s} near={near[-1][0]}{near[-1][1] > 2}"] if near else [f"s={s} near=no"]
            f += sorted({f"s={s} left={c}" for c, _ in near})
            f += sorted({f"s={s} right={c}" for c in cue[i + 1 : i + 5] if c})
            f.append(f"s={s} name={name} address={address}")
            out.append(f)
        else:
            out.append([])
        if s in ("low", "mixed", "plainword", "title", "cap", "upper"):
            words += 1
            if cue[i]:
                heard.append((words, cue[i]))
    return out


def skips(toks: list[tuple[str, str, int, int]]) -> list[tuple[int, int]]:
    """Pairs of tokens that share potentials: each token and the next of the same spelling, and a word and every address that holds it."""
    last: dict[str, int] = {}
    found = []
    mails = [(i, _plain(t[1].split("@")[0])) for i, t in enumerate(toks) if t[0] == "email"]
    for i, t in enumerate(toks):
        if t[0] in _WORDY or t[0] in _NUMBERS or t[0] == "email" or t[0] == "streetword":
            if t[1] in last:
                found.append((last[t[1]], i))
            last[t[1]] = i
            if t[0] in ("given", "cap", "upper") and mails:
                plain = _plain(t[1])
                if len(plain) > 3:
                    found += [(i, m) for m, local in mails if plain in local]
    return found


@functools.lru_cache(maxsize=10_000)
def _mask(first: str, last: str) -> tuple[float, ...]:
    """Minus a lot for each label that a token of this shape, here, can't have; from its first and last feature."""
    denied = set(range(1, len(LABELS))) - set(_allowed(first[2:]))
    denied |= {4} if "name=False" in last else set()
    denied |= {6, 7} if last.endswith("address=False") else set()
    return tuple(-1e4 * (k in denied) for k in range(len(LABELS)))


class Model:
    """Weights of features by label, of neighbouring labels, and of skip edges."""

    def __init__(self, weights: dict[str, list[float]], follow: np.ndarray, same: np.ndarray):
        self.index = {f: i for i, f in enumerate(weights)}
        self.unary = np.array([*weights.values(), [0.0] * len(LABELS)], np.float32)
        self.follow = follow.astype(np.float32)
        self.same = same.astype(np.float32)  # by class: both ends of a skip edge are of it (names and their addresses count as one)

    @classmethod
    def load(cls) -> Model:
        d = json.loads(Path(__file__).with_name("pii_weights.json").read_text())
        return cls(d["unary"], np.array(d["follow"]), np.array(d["same"]))

    def potentials(self, feats: list[list[str]]) -> np.ndarray:
        """(tokens, labels): a token without features can only be O."""
        index, last = self.index, len(self.unary) - 1
        out = np.zeros((len(feats), len(LABELS)), np.float32)
        out[:, 1:] = -1e4
        on = [i for i, f in enumerate(feats) if f]
        if on:
            at = [index.get(x, last) for i in on for x in feats[i]]
            starts = np.cumsum([0] + [len(feats[i]) for i in on[:-1]])
            out[on] = np.add.reduceat(self.unary[at], starts)
            out[on] += np.array([_mask(feats[i][0], feats[i][-1]) for i in on], np.float32)
        return out

    def decode(self, batch: list[tuple[np.ndarray, list[tuple[int, int]]]]) -> list[np.ndarray]:
        """The labels of each text: (potentials, skip edges) -> label numbers; loopy max-product."""
        result: list[np.ndarray] = [np.zeros(0, int)] * len(batch)
        # Texts with and without skip edges apart, by length, so many that a batch and its padding have a bounded size.
        order = sorted(range(len(batch)), key=lambda k: (bool(batch[k][1]), len(batch[k][0])))
        start = 0
        while start < len(order):
            end, tied = start + 1, bool(batch[order[start]][1])
            while end < len(order) and bool(batch[order[end]][1]) == tied and (end + 1 - start) * len(batch[order[end]][0]) <= BATCH_TOKENS:
                end += 1
            for k, labels in zip(order[start:end], self._labelled([batch[k] for k in order[start:end]]), strict=True):
                result[k] = labels
            start = end
        return result

    def _labelled(self, part: list[tuple[np.ndarray, list[tuple[int, int]]]]) -> list[np.ndarray]:
        size = max(1, max(len(u) for u, _ in part))
        u = np.full((len(part), size, len(LABELS)), -1e4, np.float32)
        u[:, :, 0] = 0
        for r, (own, _) in enumerate(part):
            u[r, : len(own)] = own
        edges = np.array([(r, i, j) for r, (_, pairs) in enumerate(part) for i, j in pairs], int).reshape(-1, 3)
        belief = self._chain(u)
        if len(edges):
            tie = np.where(CLASS[:, None] == CLASS[None, :], self.same[CLASS][:, None], 0).astype(np.float32)
            to_j, to_i = np.zeros((len(edges), len(LABELS)), np.float32), np.zeros((len(edges), len(LABELS)), np.float32)
            for _ in range(ROUNDS):
                bi, bj = belief[edges[:, 0], edges[:, 1]], belief[edges[:, 0], edges[:, 2]]
                new_j, new_i = self._over(bi - to_i, tie), self._over(bj - to_j, tie)
                change = max(np.abs(new_j - to_j).max(), np.abs(new_i - to_i).max())
                to_j, to_i = (to_j + new_j) / 2, (to_i + new_i) / 2
                total = u.copy()
                np.add.at(total, (edges[:, 0], edges[:, 2]), to_j)
                np.add.at(total, (edges[:, 0], edges[:, 1]), to_i)
                belief = self._chain(total)
                if change < SETTLED:
                    break
        labels = belief.argmax(2)
        return [labels[r, : len(own)] for r, (own, _) in enumerate(part)]

    @staticmethod
    def _over(belief: np.ndarray, tie: np.ndarray) -> np.ndarray:
        m = (belief[:, :, None] + tie[None]).max(1)
        return m - m.max(1, keepdims=True)

    def _chain(self, u: np.ndarray) -> np.ndarray:
        """Max-marginals along the chains."""
        forward, backward = np.zeros_like(u), np.zeros_like(u)
        for t in range(1, u.shape[1]):
            forward[:, t] = ((forward[:, t - 1] + u[:, t - 1])[:, :, None] + self.follow[None]).max(1)
        for t in range(u.shape[1] - 2, -1, -1):
            backward[:, t] = ((backward[:, t + 1] + u[:, t + 1])[:, None, :] + self.follow[None]).max(2)
        return u + forward + backward


def mentions(texts: list[str], model: Model, given: frozenset[str]) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of every mention of each text, in characters from 0."""
    toks, batch, at = [], [], []
    for text in texts:
        t = tokens(text, given)
        f = features(t)
        on = [i for i, x in enumerate(f) if x]
        toks.append(t)
        if on:
            # Tokens before the first and after the last that can be labelled are O whatever the others are; one of each is kept as a neighbour.
            low, high = max(0, on[0] - 1), on[-1] + 2
            batch.append((model.potentials(f[low:high]), [(i - low, j - low) for i, j in skips(t) if low <= i < high and low <= j < high]))
            at.append((len(toks) - 1, low))
    labels = [np.zeros(len(t), int) for t in toks]
    for (k, low), y in zip(at, model.decode(batch), strict=True):
        labels[k][low : low + len(y)] = y
    out = []
    for t, y in zip(toks, labels, strict=True):
        found: list[tuple[str, int, int]] = []
        for i in np.flatnonzero(y).tolist():
            name = LABELS[y[i]]
            if name in KINDS:
                found.append((KINDS[name], t[i][2], t[i][3]))
            elif name in ("IN", "IA"):
                kind = "name" if name == "IN" else "street_address"
                if found and i and LABELS[y[i - 1]] in (("BN", "IN") if name == "IN" else ("BA", "IA")):
                    found[-1] = (kind, found[-1][1], t[i][3])
                else:
                    found.append((kind, t[i][2], t[i][3]))
        out.append(found)
    return out


def _given(names: DataFrame | None) -> frozenset[str]:
    """Plain forms of the reference list of given names; a list beyond 100,000 names is refused, as every task holds it."""
    if names is None:
        return frozenset()
    rows = names.where("name is not null").select("name").distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("too many given names for a list in every task")
    return frozenset(_plain(r["name"]) for r in rows)


def find_mentions(df: DataFrame, ident: str, text: str, names: DataFrame | None = None) -> DataFrame:
    """(ident, kind, start_pos, end_pos) of every mention, positions in characters, the first is 1, the end inclusive.

    Null and empty texts have none; texts are taken whole; repeated rows are searched each.
    """
    given = _given(names)
    kind = df.schema[ident].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.load()
        for b in batches:
            texts = b.column(1).to_pylist()
            rows: dict[str, list[object]] = defaultdict(list)
            for start in range(0, len(texts), 4096):
                for i, found in enumerate(mentions(texts[start : start + 4096], model, given), start):
                    for k, s, e in found:
                        rows["i"].append(i)
                        rows["k"].append(k)
                        rows["s"].append(s + 1)
                        rows["e"].append(e)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows["i"], pa.int64())), pa.array(rows["k"], pa.string()), pa.array(rows["s"], pa.int32()), pa.array(rows["e"], pa.int32())], names=[ident, "kind", "start_pos", "end_pos"])

    return df.where(can_mention(F.col(f"`{text}`"))).select(ident, text).mapInArrow(search, f"`{ident}` {kind}, kind string, start_pos int, end_pos int")


def redact(df: DataFrame, text: str, names: DataFrame | None = None, out: str = "redacted") -> DataFrame:
    """``df`` with ``out``: the text with each mention replaced by its kind in square brackets; null stays null, the rest is unchanged."""
    given = _given(names)

    def replace(texts: pa.Array) -> pa.Array:
        model, result = Model.load(), []
        values = texts.to_pylist()
        at = [i for i, t in enumerate(values) if t]
        found = dict(zip(at, mentions([values[i] for i in at], model, given), strict=True))
        for i, t in enumerate(values):
            for k, s, e in reversed(found.get(i, [])):
                t = f"{t[:s]}[{k}]{t[e:]}"
            result.append(t)
        return pa.array(result, pa.string())

    body = F.col(f"`{text}`")
    return df.withColumn(out, F.when(can_mention(body), F.arrow_udf(replace, "string")(body)).otherwise(body))
