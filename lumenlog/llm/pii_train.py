"""Trains the weights of ``pii`` on generated labelled sentences: python -m lumenlog.llm.pii_train

Sentences are made from templates with invented people, so their labels are known. The templates say, in the words of log messages, notes and forms,
what the definition of each kind of mention names (a person, how to reach or identify them), and what looks like one and isn't: counts, serial and
part numbers, versions, hosts, products. HELD_OUT templates are never trained on: ``report`` measures precision and recall on them. Weights
follow from the averaged structured perceptron: each sentence is decoded with loopy message passing, and weights move towards
the true labelling and away from the decoded one. The sample is bounded by SENTENCES.
"""

from __future__ import annotations

import json
import random
import re
from collections import defaultdict
from pathlib import Path

import numpy as np

from lumenlog.llm.pii import CLASS, KINDS, LABELS, Model, _plain, features, mentions, skips, tokens

SENTENCES = 14_000
EPOCHS = 8

# Common given names in several languages, of which texts hold unknown ones too, and words of product and phase names in capitals.
GIVEN = "Adrian Alice Amina André Anna Bruno Chloé Clara Daniel Diego Elena Erik Fatima Felix Greta Helena Henrik Ingrid Irene Ivan José Julia Jürgen Karin Kenji Laura Lukas Marco Maria Martin Mei Monica Nadia Nora Olga Oliver Oscar Paula Peter Priya Ravi Samuel Simon Sofia Stefan Teresa Tomas Victor Yusuf Zoë".split()
CAPITALS = "Amber Silver Golden Copper Iron Azure Crimson Falcon Heron Otter Badger Lynx Raven Eagle Condor Central European Western Eastern Northern Pacific Release Candidate Build Version Status Error Queue Cluster Primary Backup Summer Winter Standard Time Access Denied Night Shift".split()
STREETS = "Maple Orchard Harbour Linden Mill Castle Garden Station Church Bridge Willow Quarry Meadow Abbey Hazel Cedar Foundry".split()

TEMPLATES = """
{name} signed off the change
the change was signed off by {name}
shift lead tonight is {name}, deputy {name}
escalate to {name} if {low} stays {low}
{name} and {name} looked into {low}
access for {name} granted until review
request {n} opened by {name} via {email}
locked account of {name} after {n} attempts
visitor {name} registered at gate {n}
audit: {name} changed {path}
session of {name} on {low} ended after {n} s
Dr. {name} called about {low}
Prof. {name} could not open {path}
manager: {name}
owner={name} state={low} size={n}
user "{name}" logged on to {low}
assigned engineer {name}; backup engineer {name}
Thanks, {name}
Hi {name}, disk {low} is at {n} percent
Hello {name}! Please confirm ticket {n}
Good morning {name}, {n} jobs are waiting
{name} | {phone} | {n}
{name} | {addr} | {phone}
{name} / {phone} / {low}
visit of Dr. {name} lasted {n} minutes
appointment with Dr. {name} on {ip}
link {low} runs at {n} Mb/s
{n} kB of {n} kB used, {n} kB free
fan at {n} C, limit {n} C
{low} became {low}, rate {n} kB/s
Dear {name}, the export {n} is ready
{low} reported by {name} <{email}>
{name} ({email}) joined {low}
employee {name} left the building at {n}
patient {name} was moved to ward {n}
signed: {name}, {low} {low}
please forward to {name} at {email}
{name}: mail {email}, phone {phone}
caller {name} from {phone} hung up after {n} s
applicant {name}, {addr}, id {id}
record {n}; {name}; {addr}; {phone}
{name},{email},{phone},{n}
{"name": "{name}", "tel": "{phone}", "age": {n}}
{"owner":"{name}","id":{n},"host":"{low}"}
{"address":"{addr}","person":"{name}"}
{"passport":"{id}","ok":false}
{"tax_id":"{id}","pages":{n}}
<contact><name>{name}</name><phone>{phone}</phone></contact>
mobile number of the driver: {phone}
reach the hotline on {phone} or {phone}
call {phone} before you restart {low}
dialling {phone} failed with code {n}
fax to {phone} sent, {n} pages
text message to {phone} delivered in {n} ms
phone={phone} retries={n}
tel: {phone}
msisdn {phone} not provisioned
callback requested, number {phone}
please ring {phone} and ask for {name}
new landline {phone}, old one {phone}
emergency contact {name}, {phone}
whatsapp {phone} unreachable
Telefon {phone}, Fax {phone}
Rückruf unter {phone} erbeten
joindre {name} au téléphone {phone}
llamar al teléfono {phone}
social security number {id} is not valid
ssn on record: {id}
ssn={id}
the ssn given was {id}, expected another
the social security no. of the caller is {id}
passport {id} expired on day {n}
passport no: {id}
national identity number {id} used twice
identity card {id} scanned at desk {n}
tax number {id} missing in ledger
taxpayer {id} filed {n} returns
insurance number {id} for claim {n}
national insurance {id} checked
NINO: {id}
DNI {id} leído
Steuernummer {id} geprüft
Personalausweis {id} abgelaufen
numéro de sécurité sociale {id} refusé
check of {name}: identity document {id}
case {n9}: passport {id} shown at {addr}
file {n9}: identity card {id}, home {addr}
record {n9} of {low}: tax number {id}
entry {n9}: {name}, {phone}
citizen id {id} belongs to {name}
{name} showed passport {id} issued elsewhere
ship to {addr}
home address {addr} updated
deliver parcel {n} to {addr} after noon
{name} lives at {addr}
moved from {addr} to {addr}
the courier could not find {addr}
technician sent to {addr}, contact {name}
Anschrift: {addr}
domicile {addr}
dirección {addr}
address="{addr}" floor={n}
customer {name} of {addr} asked for a refund
meter at {addr} shows {n}
return label: {name}, {addr}
mail {email} rejected: {low}
message to {email} deferred {n} times
from=<{email}> to=<{email}> size={n}
unsubscribed {email}
{email} is on the list
contact {email} for access
sender {email} recipient {email} status {low}
write to {email} or call {phone}
login {email} failed {n} times
{caps} moved {n} records to {caps}
{caps} {low} at {n} percent
started {caps} {ver}
{caps} is not reachable from {low}
phase {caps} ended after {n} s
{caps} {caps} {caps}
The {caps} was {low} on {low}
{low} {low} while {caps} was running on host {low}
Job {n} of {caps} finished
Connection {low} to {low} closed
Kernel {ver} booted in {n} ms
No route to {low}, retry {n}
read {n9} bytes from {path}
wrote {n10} bytes to {low} in {n} ms
{n11} rows scanned, {n9} kept
offset {n10} beyond end of segment {n9}
sequence {n9} out of order, expected {n9}
inode {n9} orphaned on {path}
serial {n9} of disk {n} not known
serial number {hex}{n} replaced
device {n10} offline since {n} s
packet {n} of {n9} lost
epoch {n10} behind {n10}
order number {n9} shipped by {low}
order {order} waits for stock
part {part} reordered
part number {part} obsolete
invoice {order} booked twice
account {n9} closed
transaction {n10} rolled back
ticket {n9} merged into {n9}
build {n9} failed in {n} s
job {n9} exited with {n}
job id {n10} requeued
request {n9} timed out after {n} ms
trace {hex}-{n9}-{n}
firmware {fw} rejected
driver {fw} loaded
sensor {n9}: {n} C
key {hex}{hex} rotated
checksum {n10} differs from {n10}
thread {n9} waits for lock {n9}
error code {n9} from {low}
errors: {n9}, warnings: {n9}
counter {low} is {n9}
cache holds {n9} items
timestamp {n10} in the future
SRC={ip} DST={ip} SPT={n} DPT={n} LEN={n}
MAC {mac} seen on port {n}
{low} answered {ip} in {n} ms
{low}@{low} pushed {n} commits to {path}
copied {low}@{low}:{path} to {low}
route {low} via road {low} is {low}, lane {n}
street of {n} tests, drive {n} is {low}
lane {n} down, place {n} in queue
the way to {low} is {low}, court {n}
Drive {n} replaced in bay {n}
Lane {n} of link {n} is {low}
{jargon}
{jargon}
{jargon}
{low} {low} {low}: {low} ({n})
{ver} {low} {path} {n9}
""".strip().splitlines()

HELD_OUT = """
{name} is on holiday, {name} stands in
the badge of {name} was revoked
report for {name} written to {path}
new member {name} <{email}>
handed over to {name} ({phone})
incident {n}: {name} was informed by phone
customer {name} complained about {low}
{"contact":{"name":"{name}","mobile":"{phone}"}}
guest {name} lives at {addr}
Mr. {name} asks for a copy of {path}
ssn on file: {id} confirmed
the ssn of the caller is {id}
passport number {id} could not be read
taxpayer id {id} rejected by {low}
identity document {id} presented by {name}
insurance no. {id}, holder {name}
Steuer-ID {id} gemeldet
call {phone} or {phone} please
phone {phone} is busy
sms gateway refused {phone}: {low}
tel={phone};code={n}
mobile {phone} unreachable, tried {n} times
parcel {n} returned from {addr}
delivery address: {addr}
{name} moved to {addr}
resident of {addr} since {n}
{email} bounced: {low}
cc: {email}, {email}
password of {email} changed from {ip}
{caps} handed over to {caps} in {n} ms
{caps} {ver} released on {low}
{low} read {n9} records from {path}
batch {n10} of {n9} done
volume {n9} is {low}, segment {n10}
order {order} cancelled by {low}
part {part} out of stock on shelf {n}
firmware {fw} not signed
session {n9} dropped, pid {n}
scp {low}@{low}:{path} failed after {n} s
disk serial {hex}{n9} failed
lane {n} retrained, way {n} disabled
""".strip().splitlines()


def _word(r: random.Random, least: int = 2) -> str:
    return "".join(r.choice("b d f g k l m n p r s t v z br st tr pl qu sh th".split()) + r.choice("a e i o u ai ou ea".split()) for _ in range(r.randint(least, 3))) + r.choice(["", "l", "n", "r", "sk", "x", "nd"])


_COMMON = "lost fault in dump of reset cursor table heap from at operator action needed on the owning system was is not ready stale closed pending queue disk relay router gateway backup host after while service restarted full slow idle".split()


def _low(r: random.Random) -> str:
    return r.choice(_COMMON) if r.random() < 0.4 else _word(r) + (r.choice(["", "", "01", "12"]))


def _jargon(r: random.Random) -> str:
    """Phrases of a crash report, all in capitals or the first word capitalised."""
    phrases = []
    for _ in range(r.randint(2, 6)):
        words = [_word(r) if r.random() < 0.6 else r.choice(_COMMON) for _ in range(r.randint(2, 8))]
        if r.random() < 0.4:
            words.insert(r.randint(0, len(words)), r.choice([_digits(r, 7), f"{r.getrandbits(24):06x}"]))
        phrases.append(" ".join(words))
    text = r.choice([", ", ", ", " - ", "; ", " | ", ". "]).join(phrases)
    return text.upper() if r.random() < 0.75 else text.capitalize()


def _name(r: random.Random) -> str:
    given = r.choice(GIVEN) if r.random() < 0.62 else _word(r).capitalize()
    if r.random() < 0.12:
        given += "-" + r.choice(GIVEN)
    family = _word(r).capitalize() + r.choice(["", "ström", "ović", "bach", "ham", "enko", "aro"])
    x = r.random()
    if x < 0.16:
        name = f"{family}, {given}"
    elif x < 0.26:
        name = f"{given[0]}. {family}"
    elif x < 0.36:
        name = f"{given} {r.choice('ABCDEFGHKLMRST')}. {family}"
    else:
        name = f"{given} {family}"
    return name.upper() if r.random() < 0.14 else name


def _email(r: random.Random, name: str) -> str:
    parts = [_plain(p) for p in name.replace(",", "").split()] if name else [_word(r), _word(r)]
    local = r.choice([f"{parts[0]}.{parts[-1]}", f"{parts[0]}{r.randint(1, 99)}", f"{parts[-1]}-{parts[0][:1]}", f"{parts[0][:1]}{parts[-1]}", f"{parts[0]}_{parts[-1]}{r.randint(1, 99)}", f"{parts[-1]}.{parts[0]}+log"])
    domain = r.choice(["example.com", "mail.example.org", "corp.test", "post.invalid", "hr.example.net"])
    if r.random() < 0.1:
        return r.choice([f"{local} [at] {domain.replace('.', ' [dot] ')}", f"{local}(at){domain}"])
    return f"{local}@{domain}".upper() if r.random() < 0.05 else f"{local}@{domain}"


def _digits(r: random.Random, n: int) -> str:
    return r.choice("123456789") + "".join(r.choice("0123456789") for _ in range(n - 1))


def _phone(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    return r.choice([
        f"+1 {d(3)} {d(3)} {d(4)}", f"+1.{d(3)}.{d(3)}.{d(4)}", f"+44 20 {d(4)} {d(4)}", f"+44 (0)20 {d(8)}", f"+49 30 {d(5)} {d(3)}", f"+33 1 {d(2)} {d(2)} {d(2)} {d(2)}", f"001-{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}",
        f"{d(3)}-{d(3)}-{d(4)}", f"020 {d(4)} {d(4)}", f"030/{d(5)}-{d(3)}", f"01.{d(2)}.{d(2)}.{d(2)}.{d(2)}", d(10), f"{d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(9)}", f"0{d(10)}", f"0{d(12)}",
    ])


def _id(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    return r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", d(9), d(9), d(9), f"QQ{d(6)}A", f"QQ {d(2)} {d(2)} {d(2)} C", f"{d(8)}-{r.choice('KSV')}", f"{d(8)}{r.choice('KSV')}", f"X{d(8)}", f"X{d(2)} {d(6)}", d(11), f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(2)}/{d(3)}/{d(5)}"])


def _address(r: random.Random) -> str:
    s = r.choice(STREETS) if r.random() < 0.5 else _word(r).capitalize()
    n = r.randint(1, 2500)
    return r.choice([f"{n} {s} {r.choice(['Avenue', 'St.', 'Street', 'Ave.', 'Road', 'Rd.', 'Lane', 'Drive', 'Court'])}", f"{n} {r.choice('NSEW')} {s} Blvd", f"{n} {s} Road, Apt {n % 60}", f"Flat {n % 30 + 1}, {n % 190 + 1} {s} Lane", f"{s}straße {n % 200}", f"{s}gasse {n % 90}a", f"C/ {s}, {n % 90}", f"Calle {s} {n % 150}, 3.º B", f"{n % 120}, avenue {s}", f"{n % 90} bis rue de {s}", f"{n} {s} St"])


def _other(kind: str, r: random.Random) -> str:
    """Values that are no mentions."""
    if kind == "n":
        return (_digits(r, r.randint(6, 9)) if r.random() < 0.35 else str(r.randint(1, 99999)))
    if kind in ("n9", "n10", "n11"):
        return _digits(r, int(kind[1:]))
    made = {
        "caps": lambda: " ".join(r.sample(CAPITALS, 2)),
        "fw": lambda: f"{_digits(r, 3)}.{_digits(r, 3)}.{_digits(r, r.choice([1, 2, 3, 4, 4, 5]))}",
        "part": lambda: f"0{_digits(r, 2)}-{_digits(r, 5)}-{_digits(r, 2)}",
        "order": lambda: r.choice([f"{_digits(r, 4)}-0{_digits(r, r.randint(1, 5))}-{_digits(r, r.randint(2, 5))}", f"{_digits(r, 3)}-{_digits(r, 7)}-{_digits(r, 7)}"]),
        "jargon": lambda: _jargon(r),
        "mac": lambda: ":".join(f"{r.getrandbits(8):02x}" for _ in range(6)),
        "hex": lambda: f"{r.getrandbits(32):08x}",
        "ver": lambda: f"{r.randint(1, 9)}.{r.randint(1, 30)}.{r.randint(1, 99)}",
        "ip": lambda: f"10.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}",
        "path": lambda: f"/var/lib/{_word(r)}.log",
        "low": lambda: _low(r),
    }
    return made[kind]()


def sentence(r: random.Random, templates: list[str] = TEMPLATES) -> tuple[str, list[tuple[str, int, int]]]:
    """A text and its (kind, start, end)."""
    text, spans, name = "", [], ""
    chosen = [r.choice(templates) for _ in range(1 if r.random() < 0.7 else 2)]
    template = r.choice([" - ", "; ", " | ", ". "]).join(chosen)
    if r.random() < 0.15:
        template = f"{_word(r)}: {template}"
    at = 0
    for m in re.finditer(r"\{(\w+)\}", template):
        text += template[at : m.start()]
        at = m.end()
        kind = m[1]
        if kind == "name":
            name = value = _name(r)
        elif kind == "email":
            value = _email(r, name if r.random() < 0.7 else "")
        elif kind in ("phone", "id", "addr"):
            value = {"phone": _phone, "id": _id, "addr": _address}[kind](r)
        else:
            value = _other(kind, r)
        if kind in ("name", "email", "phone", "id", "addr"):
            spans.append((kind, len(text), len(text) + len(value)))
        text += value
    return text + template[at:], spans


def gold(toks: list[tuple[str, str, int, int]], spans: list[tuple[str, int, int]]) -> np.ndarray | None:
    """Label numbers of the tokens; None where a token reaches over the start of a span."""
    y = np.zeros(len(toks), int)
    for kind, s, e in spans:
        inside = [i for i, t in enumerate(toks) if t[2] < e and t[3] > s]
        if not inside or toks[inside[0]][2] != s:
            return None
        for k, i in enumerate(inside):
            y[i] = {"email": 1, "phone": 2, "id": 3, "name": 4 + (k > 0), "addr": 6 + (k > 0)}[kind]
    return y


def train(seed: int = 7) -> dict[str, object]:
    r = random.Random(seed)
    given = frozenset(_plain(g) for g in GIVEN)
    sample = []
    while len(sample) < SENTENCES:
        text, spans = sentence(r)
        toks = tokens(text, given)
        feats = features(toks)
        y = gold(toks, spans)
        if y is not None and all(feats[i] for i in np.flatnonzero(y)):
            sample.append((feats, skips(toks), y))
    count: dict[str, int] = defaultdict(int)
    for feats, _, _ in sample:
        for f in feats:
            for x in f:
                count[x] += 1
    names = [f for f, c in count.items() if c >= 4]
    model = Model({f: [0.0] * len(LABELS) for f in names}, np.zeros((len(LABELS),) * 2), np.zeros(6))
    # Inside labels only follow their own kind.
    forbidden = np.zeros((len(LABELS),) * 2, bool)
    for inside, own in ((5, (4, 5)), (7, (6, 7))):
        forbidden[[i for i in range(len(LABELS)) if i not in own], inside] = True
    model.follow[forbidden] = -1e4
    sums = [np.zeros_like(model.unary), np.zeros_like(model.follow), np.zeros_like(model.same)]
    steps = 0
    for _ in range(EPOCHS):
        r.shuffle(sample)
        wrong = 0
        for start in range(0, len(sample), 64):
            part = sample[start : start + 64]
            got = model.decode([(model.potentials(f), s) for f, s, _ in part])
            for (feats, edges, y), z in zip(part, got, strict=True):
                if (y == z).all():
                    continue
                wrong += 1
                for i in np.flatnonzero(y != z):
                    at = [model.index[x] for x in feats[i] if x in model.index]
                    np.add.at(model.unary, (at, y[i]), 0.1)
                    np.add.at(model.unary, (at, z[i]), -0.1)
                np.add.at(model.follow, (y[:-1], y[1:]), 0.1)
                np.add.at(model.follow, (z[:-1], z[1:]), -0.1)
                for i, j in edges:
                    model.same[CLASS[y[i]]] += 0.1 * (CLASS[y[i]] == CLASS[y[j]])
                    model.same[CLASS[z[i]]] -= 0.1 * (CLASS[z[i]] == CLASS[z[j]])
                model.follow[forbidden] = -1e4
                model.same[:] = np.clip(model.same, 0, 2)
            steps += 1
            for s, w in zip(sums, (model.unary, model.follow, model.same), strict=True):
                s += w
        print("sentences with an error:", wrong, "of", len(sample))
    unary = (sums[0] / steps).round(3)
    return {"unary": {f: unary[i].tolist() for f, i in model.index.items() if np.abs(unary[i]).max() > 0.01}, "follow": np.maximum(sums[1] / steps, -1e4).round(3).tolist(), "same": (sums[2] / steps).round(3).tolist()}


def report(model: Model, templates: list[str] = HELD_OUT, n: int = 4000, seed: int = 99) -> dict[str, tuple[float, float]]:
    """(precision, recall) of each kind on sentences of templates that were not trained on."""
    r = random.Random(seed)
    sample = [sentence(r, templates) for _ in range(n)]
    got = mentions([t for t, _ in sample], model, frozenset(_plain(g) for g in GIVEN))
    kinds = dict(zip(("email", "phone", "id", "name", "addr"), ("email", "phone", "id_number", "name", "street_address"), strict=True))
    want = {(i, kinds[k], s) for i, (_, spans) in enumerate(sample) for k, s, _ in spans}
    have = {(i, k, s) for i, found in enumerate(got) for k, s, _ in found}
    out = {}
    for kind in KINDS.values():
        w, h = {x for x in want if x[1] == kind}, {x for x in have if x[1] == kind}
        out[kind] = (len(w & h) / max(1, len(h)), len(w & h) / max(1, len(w)))
    return out


if __name__ == "__main__":
    Path(__file__).with_name("pii_weights.json").write_text(json.dumps(train(), ensure_ascii=False, separators=(",", ":")))
    for kind, (precision, recall) in report(Model.load()).items():
        print(f"{kind}: precision {precision:.3f}, recall {recall:.3f}")
