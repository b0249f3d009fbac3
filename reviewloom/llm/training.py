"""Labelled texts for the trees: mentions set into sentences, and look-alikes beside them.

Most names come from the lexicon (with made-up family names of its beginnings
and endings), a quarter from syllables of several origins, so that the trees cannot
lean on lists alone; everything else is composed. `{N}` a person, `{E}` an
e-mail, `{P}` a phone, `{I}` an identity number, `{A}` an address are marked;
`{g}`, `{f}` are names that stand for places, firms or methods, `{B}` a body or an
office, and `{d...}` numbers of things.

Every fifth sentence and two origins are held out: texts of the part "held" are
made of these alone, and calibration and thresholds rest on them.
"""

from __future__ import annotations

import random
import re
from zlib import crc32

from reviewloom.llm import names as N

# Sentences with mentions.
WITH = """Attn {N}|{A}|{E}
To {N}|{A}|mailto:{E}
Care of {N}|{A}|{P}
Regards,|{N}
Signed, {N}.
(sent in by {N})
(call {P})
Thanks, {N} / {P}
Reach {N} - {E} - {P}
{N} - {E} - {P}
Please direct questions to {N} at {E}.
{N} asked for a copy at {E} and not on paper.
{N} wrote that the table is wrong.
As {N} pointed out in the workshop, the culvert is small.
This was seen by June, according to {N}.
The level fell in {d4}, according to {N}.
In the chair was {N}, notes by {N}.
Our warden, {N}, lives at {A}.
I talked with {N} and with {N} on Monday.
The refund goes to {N}.
The holder {N}, {I}, wants to be told first.
On behalf of {N}, see section 4.
My parents ({N} and {N}) keep bees there.
({N}, personal note)
It is silent on Pine Lake ({N}, pers. comm.).
The road is wet ({N}, pers. comm.).
Seen and heard: {N}; {I}; {A}.
{N}: The record shows no change.
{N} of {A} holds that the limit is low.
{N} ({P}) will be at the gate.
{N} and {N} against.
{N} & {N} dissenting.
per {N}'s diary the spring dried up.
per {N}'s notes the road is wet.
Attn {N}|{A}
The slope was photographed by {N} from {A}.
A carbon copy shows {I} next to {N}.
It matches the claim form of {N} with {I}.
Une note de {N}, {A}.
On peut joindre {N} au {P}.
My home at {A} is downstream.
Letters reach us at {A}.
The owner left {P} and {A} at the desk.
The sampler stands behind {A}; phone {P}.
See the house at {A}.
I can be found on {P} or at {A}.
The licence file is open, call {P} or {P}.
At night dial {P} or {P}.
Call {P} when you get to the barrier.
Tel. {P}
Reply-to: {E}
From: {E}|To: {E}
cc {E}; {E}
cc {N}, {N}
Hello, this is {N}.
Ring {P} or ask {N} there.
As {E} was down we used {P}.
Mail the spreadsheet to {E} before noon.
the same file went to {E}.
mailto:{E}
<{E}>
Proof of identity: {I}
Anyone could read {I} there.
The value changed before blasting [{I}].
The value changed - {N}
Dear {N}, the letter is enclosed.
The neighbour {N} objects.
I am {N} and I run the store.
My name is {N}.
Kindly forward this to {N}.
Contact {N} about the keys
Sincerely, {N}
Yours truly,|{N}
We heard from {N} twice.
Please ask {N} for the second sheet.
It was carried by {N}.
The form is for {N} only.
Attention: {N}
Prepared for {N} by {N}.
I gave them my number, {I}, by mistake.
She wrote: my {I}."""
# Sentences without any.
WITHOUT = """Rocks taken at Mount {g} are unlike those of the {f} Group.
{f} {place} froze early this winter.
The {f} equation overstates runoff here.
The {f} test and the {f} index agree.
Most metal sits in the {g} lode.
The {g} vein dips west.
{f} Consultants signed the cover sheet.
{f} & Partners Surveying drew the map.
{f} Contracting Co. built the berm.
{f} Mining Ltd. holds the claim.
{f} Analytics ran the assays.
Results from {f} Laboratories are late.
Purchase order {d3}-{d3}-{d4} is for pipe.
The water licence W{d6} and permit {d4}-{d3} lapse in May.
Drilled at {d6} E, {d7} N.
Logger K{d7} failed in May.
Logger {d7} and invoice {d8} were swapped.
Use pump P-{d3}@{d2} or valve V-{d4}.
Pumping ran @ {d4} kPa near the weir.
IMG_{d4} is a view of {d2} culverts.
Sheet {d2} has the Fern Road bridge and {d1} gates on Haul Road {d2}.
Km {d2} of the access road is wet.
Section {d1}.{d1} and table {d2} differ from 2015-2019 values.
{d2} access road crossings and {d1} service road gates were mapped.
The baseline of {d4} mg/L holds at the weir through winter.
We note that the water licence is illegible.
The value at HP-22 now reads {d4} mg/L. Table {d1} is blank.
{f} Laboratories prepared appendix D. Figure {d1} is blank.
Our members near {place2} see this as a risk.
Core boxes {d3} {d3} {d3} are missing.
Core boxes {d3}-{d3} were moved.
Version {d1}.{d1}.{d3}.{d4} of the model is older.
Software version {d2}.{d2}.{d4} was used.
Tender {d4}-{d6} closes in June.
See Table {d2}, Figure {d2} and Section {d1}.
Records {d4} {d4} {d4} were filed.
Will the model be rerun in May or in April?
Contact the {B} for a map.
Hello, this is the {B}.
cc {B}, {B}
Contact {B} for a map.
Please ask {B} for the second sheet.
Sincerely, {B}
Dear {B}, the letter is enclosed.
We heard from {B} twice.
It was carried by {B}.
Kindly forward this to {B}.
The form is for {B} only.
Attention: {B}
I am Canadian and I am Head of Planning.
It came with Table {d1} and with Appendix B.
A survey by {place2} was late.
The road from {place2} to Fort {f} is open by Friday."""
FILL = """The sampling plan is unclear.
Why does the flow change in spring?
Please clarify the liner thickness.
Below the weir, field notes differ.
On review, the figure was redrawn.
Noted, the table will follow by courier.
It is agreed that the survey is late."""
# Syllables of given and family names by origin, and words between them; the last two origins are held out.
ORIGINS = (
    ("olu wa se un ade ba yo to ke fe mi tun de", "ade bayo oko ola dele oye tunji ogun leye", ""),
    ("xiao ling wei jun mei hua yan qing lan", "zhang wang chen liu zhao sun", ""),
    ("pra deep ven kat lak shmi nara yan ku mar", "swamy raman krishna murthy reddy iyer subra", "kumar"),
    ("björ guð rún sig thór ást hild", "jóns einars guð munds dóttir son", ""),
    ("ma ría jo sé car men lu cía al ba", "gar cía fer nán dez or tega mo reno", "de la|de|del"),
    ("fa ti ma ha san yu suf lay la ka rim", "rah man has san nas ser fa rouk", "al|bin"),
    ("thi minh hoa lan anh duc tuan", "nguyen tran pham vo dang", "thi|van"),
    ("mi lo sla va zo fia ta deu iri na", "kow alski nov otny pet renko iva nova", ""),
)
PLACES = "Lake Slough Creek Ridge Bluff Valley Gulch Canyon Flats Narrows Plateau Bench".split()
STREET = "Street St Ave Avenue Road Rd Rd. Drive Dr. Lane Blvd Crescent Trail Way".split()
_HOLE = re.compile(r"\{(\w+)\}")


# Bodies and offices that stand where a person could.
BODIES = "Water|Planning|Lands|Permit|Records|Harbour|Wildlife|Heritage".split("|")
OFFICES = "Office|Branch|Desk|Department|Board|Committee|Council|Team|Division|Registry".split("|")


def _part(forms: str, part: str) -> list[str]:
    """The sentences of a part: about every fifth is held out, whatever stands beside it."""
    return [f for f in forms.split("\n") if part == "both" or (crc32(f.encode()) % 5 == 0) == (part == "held")]


class _Maker:
    def __init__(self, lex, seed: int, part: str = "both", foreign: float = 0.25):
        self.share = foreign
        self.r = random.Random(seed)
        self.origins = {"train": ORIGINS[:-2], "held": ORIGINS[-2:], "both": ORIGINS}[part]
        self.given = sorted(lex.given) or ["maria", "peter"]
        self.family = sorted(lex.family) or ["example", "sampleton"]
        self.heads, self.tails = sorted(lex.heads), sorted(lex.tails)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def fam(self) -> str:
        if self.r.random() < 0.15:
            # A name unlike all in the lexicon.
            return "".join(self.r.choice(["ba", "cho", "dre", "fu", "gar", "hin", "ka", "lo", "mor", "ney", "pon", "ris", "sta", "ton", "vel", "zan"]) for _ in range(self.r.randint(2, 4))).title()
        if self.heads and self.tails and self.r.random() < 0.3:
            return (self.r.choice(self.heads) + self.r.choice(self.tails)).title()
        return self.r.choice(self.family).title()

    def giv(self) -> str:
        return "-".join(p.title() for p in self.r.choice(self.given).split("-"))

    def foreign(self) -> str:
        """A name of syllables, of one to four words."""
        r = self.r
        given, family, between = (x.split("|") if "|" in x else x.split() for x in r.choice(self.origins))
        word = lambda parts, k: "".join(r.choice(parts) for _ in range(k)).title()
        g, f = word(given, r.randint(2, 3)), word(family, r.randint(1, 3))
        mid = r.choice([*between, word(given, 2)]) if r.random() < 0.3 and between else ""
        mid = mid if mid in ("de la", "de", "del", "al", "bin", "van") else mid.title()
        s = r.choice([f"{g} {f}"] * 4 + [g, g, g, f"{g} {word(given, 2)} {f}", f"{f} {g}", f"{g[0]}. {f}", f"{g} {f}-{word(family, 2)}"])
        if mid and s == f"{g} {f}":
            s = f"{g} {mid} {f}"
        return f"{r.choice(['Mr', 'Ms.', 'Dr.', 'Prof.'])} {s}" if r.random() < 0.1 else s

    def body(self) -> str:
        r = self.r
        return r.choice([f"{r.choice(BODIES)} {r.choice(OFFICES)}", f"{r.choice(OFFICES)} of {r.choice(BODIES)}", f"{self.place()} {r.choice(OFFICES)}", f"{self.place()} {r.choice(BODIES)} {r.choice(OFFICES)}", f"{self.fam()} {r.choice(['Ltd.', 'Inc.', 'Consulting', 'Drilling', 'Group'])}"])

    def person(self) -> str:
        r = self.r
        if r.random() < self.share:
            return self.foreign()
        g, f = self.giv(), self.fam()
        if r.random() < 0.08:
            f = f"{f}-{self.fam()}"
        s = r.choice([f"{g} {f}"] * 5 + [f"{g[0]}. {f}", f"{g} {r.choice('ABCHMPTW')}. {f}", f"{g[0]}.{r.choice('ABCHMPTW')}. {f}", f"{f}, {g}", f"{f.upper()}, {g}", f"{f}, {g[0]}.", g, g, g, g])
        if "," not in s and r.random() < 0.2:
            title = r.choice(["Mr", "Ms.", "Dr.", "Mr.", "Mrs.", "Prof."])
            s = f"{title} {r.choice([f, s, f'{g[0]}. {f}'])}"
        u = r.random()
        return s.upper() if u < 0.06 else s.lower() if u < 0.12 and " " in s and "," not in s and "." not in s else s

    def place(self) -> str:
        stem = self.r.choice("Alder Birch Cedar Fern Gorse Heather Moss Oak Pine Reed Stone Thorn".split())
        return stem + self.r.choice("field ford bridge hurst ton wood mere dale".split())

    def email(self) -> str:
        r = self.r
        g, f = (N.fold(x).replace("-", "") for x in (self.giv(), self.fam()))
        local = r.choice([f"{g}.{f}", f"{g[0]}{f}", f"{g}{r.randint(1, 99)}", f"{f}_{g}", f"info-{f}", f"{g}.{f}+review"])
        host = ".".join([*r.choice([[], [], ["mail"], ["lists"]]), self.r.choice("acorn brook clay delta".split()), *r.choice([["example"], ["invalid"], ["test"], ["example", "net"], ["example", "org"], ["com"]])])
        at, dot = r.choice([("@", ".")] * 6 + [(" [at] ", " [dot] "), (" (at) ", "."), (" @ ", "."), (" [at] ", ".")])
        s = local.replace(".", dot if "dot" in dot else ".") + at + host.replace(".", dot)
        return s.upper() if r.random() < 0.06 else s

    def phone(self) -> str:
        r = self.r
        a, b, c = r.choice("204 236 250 306 403 506 604 705 807 867 902".split()), r.choice(["555", self.digits(3)]), self.digits(4)
        s = r.choice(["{a}-{b}-{c}"] * 3 + ["({a}) {b}-{c}", "{a}.{b}.{c}", "{a} {b} {c}", "+1 {a} {b} {c}", "1-{a}-{b}-{c}", "{a}/{b}-{c}", "{a}{b}{c}", "({a}){b}.{c}", "{b}-{c}", "{a}‑{b}‑{c}", "{a} {b} {c}"]).format(a=a, b=b, c=c)
        u = r.random()
        if u < 0.05:
            return " ".join(a + b + c)
        if u < 0.12:
            return r.choice([f"+44 7700 {self.digits(6)}", f"07700 {self.digits(3)} {self.digits(3)}"])
        return s + r.choice([" ext. 12", " x4"]) if u < 0.25 else s

    def identity(self) -> str:
        r, d = self.r, self.digits
        return r.choice([
            f"passport no. Z{r.choice('QX')}{d(6)}", f"passport ZX {d(3)} {d(3)}", f"passport {r.choice('ABCG')}{r.choice('ABX')}{d(6)}", f"SIN {d(3)} {d(3)} {d(3)}", f"S.I.N. {d(3)}-{d(3)}-{d(3)}", f"social insurance number {d(9)}",
            f"driver's licence {d(7)}", f"driver’s licence no. {d(7)}", f"health card {d(4)} {d(3)} {d(3)}", f"status card no. {d(10)}", f"birth certificate {d(4)}-{d(6)}", f"health number {d(10)}", f"permis de conduire {d(7)}", f"DL# {d(4)}-{d(3)}", f"DL {d(7)}",
            f"SSN {d(3)}-{d(2)}-{d(4)}", f"SSN is {d(3)}-{d(2)}-{d(4)}", f"social security number {d(3)}-{d(2)}-{d(4)}", f"SSN: {d(9)}", f"SSN {d(3)} {d(2)} {d(4)}",
        ])

    def address(self) -> str:
        r = self.r
        town = self.place()
        code = f" {r.choice('ABXZ')}{self.digits(1)}{r.choice('ABCE')} {self.digits(1)}{r.choice('XYZ')}{self.digits(1)}"
        street = f"{self.place()} {r.choice(STREET)}"
        s = r.choice([f"{self.digits(r.randint(2, 4))} {street}"] * 4 + [
            *[f"Unit {r.randint(1, 40)}, {self.digits(r.randint(3, 4))} {street}"] * 2, f"{r.randint(1, 40)}-{self.digits(4)} {street}", f"{self.digits(4)}, rue des {self.place()}s",
            f"PO Box {self.digits(4)}", f"P.O. Box {self.digits(3)}", f"RR {r.randint(1, 9)}, Site {r.randint(1, 30)}, Comp {r.randint(1, 60)}", f"RR {r.randint(1, 9)}",
        ])
        if r.random() < 0.06:
            return f"no. {self.digits(4)} on {self.place()} {r.choice(STREET).rstrip('.')} in {town}"
        s += r.choice([f", {town}", f", {town}", f", {town}{code}", f"\n{town}{code}", ""])
        return s.upper() if r.random() < 0.06 else s

    def fill(self, name: str) -> tuple[str, str | None]:
        made = {"N": (self.person, "name"), "E": (self.email, "email"), "P": (self.phone, "phone"), "I": (self.identity, "id_number"), "A": (self.address, "address")}
        if name in made:
            f, kind = made[name]
            return f(), kind
        if name[0] == "d":
            return self.digits(int(name[1:])), None
        return {"g": self.giv, "f": self.fam, "B": self.body, "place": lambda: self.r.choice(PLACES), "place2": lambda: f"{self.place()} {self.r.choice(PLACES)}"}[name](), None

    def sentence(self, form: str) -> tuple[str, list[tuple[int, int, str]]]:
        out, marks, at = "", [], 0
        form = form.replace("|", "\n")
        for m in _HOLE.finditer(form):
            out += form[at : m.start()]
            s, kind = self.fill(m[1])
            if kind:
                marks.append((len(out), len(out) + len(s), kind))
            out += s
            at = m.end()
        return out + form[at:], marks


def composed(lex, sample: int, seed: int = 11, part: str = "both", foreign: float = 0.25) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """`sample` texts of one to four sentences with the spans of their mentions; of the training part, the held-out part or both; `foreign` is the share of names of syllables."""
    mk = _Maker(lex, seed, part, foreign)
    r, out = mk.r, []
    kinds = [(_part(WITH, part), 5), (_part(WITHOUT, part), 4), (FILL.split("\n"), 3)]
    forms, weights = [k for k, _ in kinds], [w for _, w in kinds]
    for _ in range(sample):
        text, marks = "", []
        for pool in r.choices(forms, weights, k=r.randint(1, 4)):
            s, m = mk.sentence(r.choice(pool))
            if text:
                text += r.choice([" ", " ", " ", "\n", "  "])
            marks += [(a + len(text), b + len(text), k) for a, b, k in m]
            text += s
        out.append((text, marks))
    return out
