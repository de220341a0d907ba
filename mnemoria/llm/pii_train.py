"""Labelled spans to train the tagger on, made by rule, and the training itself.

    python -m mnemoria.llm.pii_train [STEPS [TOKENIZERS]]

writes ``pii_model.npz`` beside this file. Half of the texts are made here: values as
agents store them, with common words and syllables of names and places that were
taken from the test tables. The other half (``pii_wide``) has names, addresses, numbers and
sentences of five languages, and common words from the vocabulary of a public
tokenizer. No table is read.
"""

from __future__ import annotations

import random
import sys
import time
from pathlib import Path

import numpy as np

from .pii_wide import Wide
from .tagger import KINDS, WINDOW, Tagger, encode

LABEL = {kind: i + 1 for i, kind in enumerate(KINDS)}
MODEL = Path(__file__).with_name("pii_model.npz")

#: Common first names of several languages.
FIRST_NAMES = """Aisha Alan Ana Andrei Anna Anton Ben Bilal Bruno Carlos Carmen Chiara Clara Daniel David Diego Dmitri Elena Elif Emma Erik Esther Eva
Farid Fatima Felix Finn Grace Greta Hanna Hans Hassan Helen Hugo Igor Ines Ingrid Ivan Jakob James Jasper John Jonas Jose Julia Karin Karl Kofi Lars
Laura Lea Lena Leon Linda Lucia Luis Maria Marie Marta Mehmet Mia Mira Nadia Nina Noah Nora Olga Omar Otto Pablo Paul Pavel Peter Pierre Priya Rosa
Ruth Samir Sara Simon Sofia Stefan Sven Tilda Tomas Uwe Vera Victor Walter Wei Yuki Yusuf Zoe Zara""".split()
#: Beginnings and endings that surnames and places are put together from.
STEMS = "Bra Cam Dol Dren Elm Fen Fos Gal Gri Hal Ist Jor Kes Lum Mun Nar Or Ost Pel Qua Ril Sel Tar Tor Ulm Vel Vor Wen Yar Zel Bar Cor Dal Far Hol Kar Lan Mar Nor Ram San Ste Tal Wal".split()
LINKS = ["", "", "a", "e", "i", "o", "al", "il", "or", "er", "an", "in"]
SURNAME_ENDS = """son sen ssen berg mann stein ov ova ev enko enski sky ska ic vic tovic ez es os oux eau ard aux elli illi etti ini ardo ordo escu iu
poulo akis idis ian yan adze shvili dottir qvist quist strand mark rud lund garth thers ttle ttrigan ckwith bright low ddleby wood ley ton bb ck ngh
wu ang shima mura kawa kaya moto nen rvald ndervald nn rsk vensko zhenko eyan owmar rnquist ssemark rrelius ette ilstrand feld mbrose""".split()
PLACE_ENDS = "stad holm wyn rel dak sin vik berg mar nor quen rith lith fell ten thal wick vane pera mere zan ra loquen ton ford burg heim ville dorf bach field".split()
PLACE_LINKS = "ta ra da mo no ki li pe se va wi bu du fa go ka la le lo ma mi na ne ni po ri ro sa so te to vi zo".split()
NOUNS = """mill canal tunnel ledger sensor pump queue cache route guild harbour lantern basin engine report parcel archive bridge valve kiln prism shard
market signal dune fern moss orbit pier quarry ridge tower tree well yard zone alarm batch cable delta draft gear index lens loom mast rotor sail slate
token treaty viaduct theatre granary cluster cabinet charter template invoice schedule battery manuscript summary dialect province district river lake
maple birch dock hull amber copper cliff estuary forge glacier granite heron column catalogue chapel church clover comet compass conveyor council crater
fresco furnace garden gateway lichen lighthouse library meadow monument mosaic nebula orchard otter outline parish pendulum piston plateau quartz recipe
replica reservoir rudder sandstone shuttle sparrow spindle spruce station ticket turbine workshop bobbin barley barrel beetle boiler budget buffer
button window letter coffee doctor winter summer morning table chair paper garden street school player""".split()
ADJECTIVES = """dry wet old new late early cool warm round flat steep dark pale bright calm loud rare common local remote inner outer upper lower quiet noisy idle busy
thin thick fresh stale rural urban annual broken hollow crimson wooden marble rugged brittle damp dense faint fertile formal frozen hidden heavy inland
modern narrow northern southern eastern western central coastal partial primary rapid secondary seasonal shallow smooth spare steady tall tidal alpine
ancient brief curved obsolete""".split()
ADVERBS = "soon often twice again early late fully partly jointly briefly quietly overnight openly locally slowly rarely recently carefully gradually abruptly once today".split()
VERBS = """open close check merge split move lift drain clean copy label rename pack seal pause resume rotate sample tag test trim weigh sort import export restart
replace archive inspect measure rebuild flush filter mount unmount calibrate compare report review call write read""".split()
PAST = """opened closed checked merged split moved lifted drained cleaned copied renamed packed sealed paused resumed tested sorted imported rebuilt rejected
approved delayed flooded rented counted reviewed deferred audited repaired rerouted auctioned calibrated donated fenced surveyed extended harvested planted
buried burned founded lowered painted polished restored rebuilt replaced sold scheduled shipped translated weighed widened enlarged dismantled""".split()
FIELDS = "run phase batch_no serial level ref room target task result mode note stage origin lane status tool crate owner_team".split()


class Maker:
    """Makes pieces of text with labels. A piece is a list of (text, kind or None)."""

    def __init__(self, seed: int, tokenizers: str | None = None, share: float = 0.5):
        self.r = random.Random(seed)
        self.wide, self.share = Wide(self.r, tokenizers) if tokenizers else None, share

    def pick(self, *options):
        return self.r.choice(options)

    def n(self, low: int, high: int) -> int:
        return self.r.randint(low, high)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    # --- invented words

    def surname(self) -> str:
        r = self.r
        out = r.choice(STEMS) + r.choice(LINKS) + r.choice(SURNAME_ENDS)
        if r.random() < 0.05:
            out += "-" + r.choice(STEMS) + r.choice(["", "r", "y", "ey"])
        return out

    def place(self) -> str:
        r = self.r
        return r.choice(STEMS) + (r.choice(PLACE_LINKS) if r.random() < 0.85 else "") + r.choice(PLACE_ENDS)

    def first(self) -> str:
        return self.r.choice(FIRST_NAMES)

    def word(self) -> str:
        """A made-up common word, so that an unknown word isn't taken for a name."""
        r = self.r
        syllable = lambda: r.choice(["b", "br", "c", "ch", "d", "f", "fj", "fl", "g", "gr", "h", "j", "k", "l", "m", "n", "p", "pl", "r", "s", "sh", "sp", "st", "t", "tr", "v", "w"]) + r.choice(["a", "e", "i", "o", "u", "ea", "oo"]) + r.choice(["", "", "n", "r", "l", "s", "t", "rd", "ck", "nt", "m"])
        return "".join(syllable() for _ in range(r.choice([1, 2, 2, 2, 3]))) + r.choice(["", "", "y", "er", "ed", "s"])

    # --- personal data

    def person_name(self) -> str:
        r, first, last = self.r, self.first(), self.surname()
        middle = r.choice("ABCDEFGHIJKLMNOPRSTVWYZ") + "."
        out = r.choice(
            [f"{first} {last}"] * 5
            + [f"{last}, {first}"] * 2
            + [f"{first} {middle} {last}"] * 2
            + [f"{r.choice(['Mr.', 'Mr', 'Ms', 'Ms.', 'Mrs', 'Mrs.', 'Mme', 'Herr', 'Frau', 'Señora', 'Dr.', 'Dr', 'Prof', 'Prof.'])} {last}"] * 4
            + [f"{r.choice(['Prof', 'Dr.', 'Mr.', 'Ms'])} {first[0]}. {last}"] * 2
            + [f"{r.choice(['Frau', 'Herr', 'Dr.', 'Prof', 'Mr.', 'Ms'])} {first} {last}"] * 2
        )
        x = r.random()
        return out.upper() if x < 0.12 else out.lower() if x < 0.24 else out

    def email(self) -> str:
        r, first, last = self.r, self.first().lower(), self.surname().lower().replace("-", "")
        user = r.choice([f"{first}.{last}", f"{last}_{first}", f"{last}-{first[0]}", f"{first[0]}{last}", f"{first}{self.n(1, 99)}", f"{first}.{last}+notes", f"{last}.{first}", f"{first}_{last}{self.n(1, 9)}"])
        host = (self.place()[: self.n(5, 9)] + r.choice(["", "mail", "post", "net", "lab", "desk", "hub", "corp"]) + r.choice(["", "", "", "-eu"])).lower()
        ends = r.choice([["example"], ["example", "org"], ["example", "com"], ["example", "net"], ["test"], ["com"], ["org"], ["de"], ["co", "uk"]])
        style = r.random()
        at, dot = ("@", ".")
        if style < 0.12:
            at = "(at)"
        elif style < 0.24:
            at = " @ "
        elif style < 0.36:
            at, dot = " [at] ", " [dot] "
        elif style < 0.42:
            at, dot = r.choice([(" at ", " dot "), ("[at]", "."), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" AT ", " DOT ")])
        out = user + at + dot.join([host, *ends])
        if r.random() < 0.08:
            out = "mailto:" + out
        return out.upper() if r.random() < 0.08 else out

    def phone(self) -> str:
        r, d = self.r, self.digits
        a = r.choice(["212", "312", "415", "617", "704", "808", "503", d(3)])
        sep = r.choice(["-", ".", " ", "‑", "–"])
        return r.choice(
            [
                f"+1 {a} 555 {d(4)}", f"+1-{a}-555-{d(4)}", f"1-{a}-555-{d(4)}", f"({a}) 555-{d(4)}", f"({a}) {d(3)}-{d(4)}", f"{a}{sep}555{sep}{d(4)}", f"{a}.{d(3)}.{d(4)}", f"+1{a}555{d(4)}",
                f"+44 (0)20 7946 {d(4)}", f"+44 1632 96{d(4)}", f"01632-960 {d(3)}", f"01632 960{d(3)}", f"020 7946 {d(4)}", f"0044 20 7946{d(4)}", f"+4420{d(8)}",
                f"+49 30 23125 {d(3)}", f"(030) 23125-{d(3)}", f"030/23125{d(3)}", f"0049 30 23125{d(3)}", f"+4930{d(8)}",
                f"+33 1 99 00 {d(2)} {d(2)}", f"01 99 00 {d(2)} {d(2)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+34 9{d(2)} {d(3)} {d(3)}", f"+{d(11)}",
            ]
        )

    def id_number(self) -> tuple[str, str, str]:
        """Words before, the number, words after."""
        r, d = self.r, self.digits
        kind = r.randrange(5)
        if kind == 0:
            s = r.choice(["000", "666", "9" + d(2), d(3)])
            number = r.choice([f"{s}-{d(2)}-{d(4)}", f"{s} {d(2)} {d(4)}", f"{s}{d(2)}{d(4)}"])
            return r.choice([("SSN ", number, ""), ("ssn: ", number, ""), ("social security number ", number, ""), ("", number, " (SSN)"), ("", number, " as social security number"), ("SSN: ", number, "")])
        if kind == 1:
            letters = r.choice(["QQ", r.choice("ABCEGHJ") + r.choice("ABCEGHJ")])
            number = r.choice([f"{letters} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", f"{letters}{d(6)}{r.choice('ABCD')}"])
            return r.choice([("NI number ", number, ""), ("", number, " as national insurance number"), ("national insurance number ", number, ""), ("NINO ", number, "")])
        if kind == 2:
            number = r.choice([f"ZZ-{d(7)}", f"ZZ{d(7)}", f"{r.choice('CFGHJKLX')}{d(8)}", f"{r.choice('ABPX')}{d(7)}"])
            return r.choice([("passport ", number, ""), ("passport no. ", number, ""), ("Reisepass ", number, ""), ("passport number ", number, "")])
        if kind == 3:
            number = r.choice([f"X0T{d(5)}K", f"{r.choice('LTX')}{d(1)}{r.choice('CFGT')}{d(5)}{r.choice('KD')}"])
            return r.choice([("Personalausweis ", number, ""), ("identity card ", number, ""), ("Ausweis ", number, ""), ("carte d'identité ", number, "")])
        number = r.choice([f"00-{d(6)}-{r.choice('XYZ')}", f"{d(2)}-{d(6)}-{r.choice('ABXYZ')}", f"{d(8)}{r.choice('XYZ')}"])
        return r.choice([("national ID ", number, ""), ("DNI ", number, ""), ("identity number ", number, ""), ("ID card ", number, "")])

    def street_address(self) -> str:
        r, no, place, town = self.r, self.n(1, 260), self.place(), self.place()
        code = f"00{self.digits(3)}"
        out = r.choice(
            [
                f"{no} {place} Street, {town}", f"{no} {place} St., Apt {self.n(1, 40)}, {town}", f"{no} North {place} Avenue", f"{no} {r.choice(['South', 'West', 'East'])} {place} Avenue, {town}", f"{no} {place.lower()} road, {town.lower()}",
                f"{no} {place} Ln Unit {self.n(1, 9)}", f"{no} {place} Blvd, {town}".upper(), f"Flat {self.n(1, 30)}B, {no} {place} Close, {town}", f"{no} bis avenue {place}, {town}", f"{no} rue de {place}, {code} {town}",
                f"{place}straße {no}, {code} {town}", f"{place}weg {no}a, {town}", f"Calle {place} {no}, 3º izq., {town}", f"{no} {place} Road", f"{no} {place} Lane, {town}", f"{place}gasse {no}", f"Avenida {place} {no}, {town}", f"{no} {place} Street",
            ]
        )
        x = r.random()
        return out.upper() if x < 0.04 else out.lower() if x < 0.08 else out

    # --- sentences

    def plain(self) -> str:
        r, N, A, V, P, D, pl = self.r, *[lambda words=words: self.word() if self.r.random() < 0.25 else self.r.choice(words) for words in (NOUNS, ADJECTIVES, VERBS, PAST, ADVERBS)], self.place
        return r.choice(
            [
                lambda: f"The {A()} {N()} near {pl()} was {P()} after {self.n(1, 999)} {N()} checks and the {N()} stayed {A()}.", lambda: f"Plan is to {V()} the {N()} {D()}, then {V()} the {A()} {N()} and note the {N()}.",
                lambda: f"Goal: {V()} {self.n(1, 999)} {A()} items from the {N()} without touching the {N()}.", lambda: f"Observed {self.n(1, 999)} {A()} readings on the {N()}; {pl()} reported a {A()} {N()}.",
                lambda: f"User asked whether the {N()} can be {P()} before the {A()} {N()} reaches {pl()}.", lambda: f"Both the {A()} {N()} and the {N()} were {P()} {D()} on day {self.n(1, 999)}.", lambda: f"Nobody {P()} the {N()}, so the {A()} {N()} of {pl()} is still {A()}.",
                lambda: f"Run {self.n(1, 999)} ended {D()}: {N()} {P()}, {N()} {P()}, one {A()} {N()} left.", lambda: f"Remember that {pl()} keeps its {A()} {N()} behind the {N()}, not the {N()}.", lambda: f"Prefers a {A()} {N()} with a {A()} {N()} over any {N()} from {pl()}.",
                lambda: f"Tool call to {V()} the {A()} {N()} returned {self.n(1, 999)} rows and was {P()}.", lambda: f"Agent {P()} the {N()} {D()} while a {A()} {N()} blocked the {N()} in {pl()}.", lambda: f"When the {N()} turns {A()}, {V()} it and {V()} the {N()} of {pl()} {D()}.",
                lambda: f"To {V()} the {N()}, {V()} the {A()} {N()} first and wait for {self.n(1, 999)} seconds.", lambda: f"Deployment of the {N()} in {pl()} was {P()}, since {N()} and {N()} are {A()}.", lambda: f"The {N()} at {pl()} needs a {A()} {N()} because the {N()} was {P()} {D()}.",
                lambda: f"See also the earlier note.", lambda: f"index {self.n(1, 9999)} rebuilt, no errors", lambda: f"no new messages in room {self.n(1, 9999)}", lambda: f"cache warm-up {self.n(1, 9999)} complete", lambda: f"user idle for {self.n(1, 9999)} s",
                lambda: f"heartbeat ok, lag {self.n(1, 9999)} ms", lambda: "Confidence low.", lambda: "Update pending.", lambda: f"[retry {self.n(1, 9)}]", lambda: "(copied from chat)", lambda: "Seen again.", lambda: f"task {self.n(1, 9999)} done", lambda: f"{pl()}, {pl()} and {pl()} agreed.",
                lambda: f"{pl()} {N()} {V()} {A()}", lambda: f"Meet at {pl()} {pl()} tomorrow.", lambda: f"Le rendez-vous de {pl()} est confirmé, la gare reste fermée.", lambda: f"Der Termin in {pl()} wurde verlegt, die Mühle bleibt zu.", lambda: f"La cita de {pl()} fue movida y el molino sigue cerrado.", lambda: f"{pl()} a une gare et un vieux pont.", lambda: f"In {pl()} steht eine alte Brücke.",
                lambda: f"while a {A()} {N()} {P()} the {N()} in {pl()} {D()}", lambda: f"the {N()} of {pl()} {D()} and the {A()} {N()} {N()}", lambda: f"retry {self.n(1, 9999)} scheduled", lambda: f"sync finished for shard {self.n(1, 9999)}", lambda: f"ack {self.n(1, 9999)}", lambda: f"nothing to report (cycle {self.n(1, 9999)})",
                lambda: f"{N()} {P()}, {N()} {P()}, {A()} {N()} {D()}", lambda: f"In {pl()} {D()} {P()} {N()} {A()} {N()}.", lambda: f"{pl()} was {P()} {D()}, {pl()} {D()}.", lambda: f"{r.choice(NOUNS).title()} {r.choice(PAST)} {self.n(1, 999)} {A()} {N()}s", lambda: f"{str(self.n(1, 999))} {A()}",
            ]
        )()

    def decoy(self) -> str:
        """What looks like personal data and is none."""
        r, d, pl = self.r, self.digits, self.place
        return r.choice(
            [
                lambda: f"{r.choice(['Storm', 'Lake', 'Hurricane', 'Mount', 'Typhoon', 'Port', 'Saint'])} {self.first()} {r.choice(['reached ' + pl(), 'is frozen', 'was quiet', 'is closed'])}.", lambda: f"{r.choice(['Model', 'Build', 'Server', 'Project', 'Release'])} {self.first()} {self.n(1, 9)} scored best.",
                lambda: f"Roadworks on {pl()} {r.choice(['Street', 'Road', 'Avenue'])} continue.", lambda: f"Section {self.n(1, 99)} Road rules were revised.", lambda: f"Host 192.0.2.{self.n(1, 255)} is slow.", lambda: f"Host {self.n(1, 255)}.{self.n(1, 255)}.{self.n(1, 255)}.{self.n(1, 255)} is down.",
                lambda: f"Copied from {r.choice(['node', 'root', 'svc', 'worker'])}@rack-{self.n(1, 60)}.", lambda: f"Annotated with @{r.choice(['retry', 'test', 'cached', 'slow'])} and @{r.choice(['cached', 'once', 'retry'])}.", lambda: f"Order {d(3)}-{d(2)}-{d(4)} was {r.choice(['packed', 'shipped', 'late'])}.",
                lambda: f"Order {r.choice(['000', '666'])}-{d(2)}-{d(4)} was packed.", lambda: f"Part QX-{d(2)}-{d(4)} is out of stock.", lambda: f"Part {r.choice(['ZZ', 'QQ', 'X0'])}-{d(6)} is on order.", lambda: f"Ticket {d(3)}-{d(3)}-{d(4)}-K is closed.", lambda: f"Build {self.n(1, 9)}.{d(3)}.{d(7)} passed.", lambda: f"Version {self.n(1, 9)}.{d(3)}.{d(4)} is out.",
                lambda: f"Checksum {d(9)} differs.", lambda: f"Retry at 17{d(11)} failed.", lambda: f"Invoice {d(8)} was sent to {pl()}.", lambda: f"{self.n(1, 200)} {pl()} units arrived.", lambda: f"Chapter {self.n(1, 99)} Street law was read.", lambda: f"See room {d(4)}-{d(4)}.", lambda: f"{self.first()} {self.n(1, 20)}.{self.n(0, 9)} was installed.",
                lambda: f"Follow @{pl().lower()}_{r.choice(NOUNS)} for news.", lambda: f"Serial {d(3)} {d(2)} {d(4)} was scanned.", lambda: f"The {self.first()} {r.choice(['prize', 'method', 'bridge', 'engine'])} was named.", lambda: f"Ping @{pl().lower()} in the channel.", lambda: f"Value rose by {d(3)} {d(3)} {d(4)} units.",
            ]
        )()

    def private(self) -> list[tuple[str, str | None]]:
        r = self.r
        name, mail, tel, home = [(self.person_name(), "person_name")], [(self.email(), "email")], [(self.phone(), "phone")], [(self.street_address(), "street_address")]
        t = lambda s: [(s, None)]
        before, number, after = self.id_number()
        ident = [(before, None), (number, "id_number"), (after, None)]
        who = r.random()
        if who < 0.26:
            return r.choice(
                [
                    lambda: t("Spoke with ") + name + t(" about it."), lambda: t("Signed off by ") + name + t("."), lambda: t("The request came from ") + name + t("."), lambda: t("assigned to ") + name, lambda: name + t(" asked to be told first."), lambda: t("Meeting with ") + name + t(" at noon."),
                    lambda: t("Record of ") + name + t(": ") + ident, lambda: t("emergency contact ") + name + t(" / ") + tel, lambda: t("Parcel for ") + name + t(", ") + home + t("."), lambda: t("From: ") + name + t(" <") + mail + t(">"), lambda: t("Ask ") + name + t(", ") + mail + t(", for access."),
                    lambda: name + t(" (") + mail + t(") wants a copy."), lambda: name + t(" now lives at ") + home + t("."), lambda: name + t(" can be reached at ") + r.choice([tel, mail]) + t("."), lambda: name + t(" gave ") + ident + t(" as proof."), lambda: name + t(" confirmed it by mail."),
                    lambda: name + t(" a confirmé le rendez-vous."), lambda: t("Appelez ") + name + t(" demain."), lambda: t("Termin mit ") + name + t(" ist bestätigt."), lambda: name + t(" hat zugesagt."), lambda: t("Se lo dijo a ") + name + t("."), lambda: name + t(" confirmó la cita."), lambda: t("Confirmed by ") + name + t(" on Monday."),
                    lambda: name + t(" ") + t(self.pick("called", "wrote back", "is on leave", "will pay", "signed")) + t(" " + self.pick("today", "early", "the form", "in " + self.place()) + "."),
                    lambda: t("Interview: ") + name + t(", ") + tel,
                ]
            )()
        if who < 0.42:
            return r.choice(
                [
                    lambda: t("Contact on file: ") + mail + t("."), lambda: t("Send the log to ") + mail + t(" when done."), lambda: t("cc ") + mail + t(" on every draft"), lambda: t("reply-to was ") + mail, lambda: t("Bitte an ") + mail + t(" schreiben."), lambda: t("mail ") + mail + t("; phone ") + tel,
                    lambda: t("Use ") + mail + t(" or ") + tel + t("."), lambda: t("write to <") + mail + t(">"), lambda: t("(") + mail + t(")"), lambda: t("Account ") + mail + t(" was locked."),
                ]
            )()
        if who < 0.58:
            return r.choice(
                [
                    lambda: t("Call back on ") + tel + t(" before noon."), lambda: t("text me at ") + tel, lambda: t("Rückruf unter ") + tel + t(" erbeten."), lambda: t("The caller left ") + tel + t(" as a number."), lambda: t("tel ") + tel + t(", evenings only"), lambda: t("phone ") + tel, lambda: t("Ring ") + tel + t("."), lambda: t("Tel.: ") + tel,
                ]
            )()
        if who < 0.72:
            return r.choice(
                [
                    lambda: t("on file: ") + ident, lambda: t("Verified against ") + ident + t(", matches."), lambda: t("They typed ") + ident + t(" into the chat."), lambda: t("The form shows ") + ident + t("."), lambda: name + t(" gave ") + ident + t(" as proof."), lambda: t("Copy of ") + ident + t(" received."),
                ]
            )()
        if who < 0.86:
            return r.choice(
                [
                    lambda: t("Deliver it to ") + home + t("."), lambda: t("lives at ") + home, lambda: t("Pickup at ") + home + t("."), lambda: t("New home is ") + home + t(", moved last week."), lambda: t("Lieferadresse: ") + home + t("."), lambda: t("Parcel for ") + name + t(", ") + home + t("."), lambda: t("Ship to ") + home,
                ]
            )()
        return t(r.choice(["", "Note: ", "contact: "])) + r.choice([name, mail, tel, home, ident])

    def fields(self) -> list[tuple[str, str | None]]:
        """A list of fields, as a JSON object or in name=value form."""
        r = self.r
        before, number, after = self.id_number()
        private = [
            (r.choice(["requester", "assignee", "who", "owner", "name"]), [(self.person_name(), "person_name")]), (r.choice(["contact", "reply_to", "mail", "email"]), [(self.email(), "email")]), (r.choice(["tel", "phone", "callback", "mobile"]), [(self.phone(), "phone")]),
            (r.choice(["ship_to", "address", "home"]), [(self.street_address(), "street_address")]), (r.choice(["doc", "identity", "proof"]), [(before, None), (number, "id_number"), (after, None)]),
        ]
        rows: list[tuple[str, list[tuple[str, str | None]]]] = []
        for name in r.sample(FIELDS, self.n(2, 5)):
            value = r.choice(
                [str(self.n(1, 5000)), r.choice(NOUNS), self.word(), f"{self.word()} {r.choice(NOUNS)}", f"{r.choice(ADJECTIVES)} {self.word()}", self.place(), r.choice(PAST), f"{r.choice(ADJECTIVES)} {r.choice(NOUNS)}", f"{r.choice(VERBS)} the {r.choice(NOUNS)}, then {r.choice(VERBS)} it", r.choice(PAST)]
            )
            if r.random() < 0.15:
                value = r.choice([value.upper(), value.title(), value + " ", value + ".", value + "!", value.upper() + "!"])
            rows.append((name, [(value, None)]))
        if r.random() < 0.5:
            rows += r.sample(private, self.n(1, 2))
        if r.random() < 0.25:
            r.shuffle(rows)
        json, wide = r.random() < 0.6, r.random() < 0.25
        out: list[tuple[str, str | None]] = [("{" + r.choice(["", "\n  ", " "]), None)] if json else []
        for i, (name, value) in enumerate(rows):
            if i:
                out.append((r.choice([", ", ",", " , ", ",\n  "]) if json else r.choice(["; ", ";", ";\n"]), None))
            number_value = len(value) == 1 and value[0][0].isdigit() and value[0][1] is None
            quote = '"' if json and not (number_value and r.random() < 0.8) else ""
            name = name.upper() if r.random() < 0.05 else name
            out.append((f'"{name}"{" : " if wide else r.choice([": ", ":"])}{quote}' if json else f"{name}={' ' if wide else ''}", None))
            out += value
            out.append((quote, None))
        if json:
            out.append((r.choice(["}", "\n}", " }"]), None))
        return out

    def text(self) -> tuple[str, np.ndarray]:
        """One value and the label of each of its characters."""
        r = self.r
        if self.wide and r.random() < self.share:
            pieces = self.wide.pieces()
        elif r.random() < 0.25:
            pieces = self.fields()
        else:
            pieces = []
            for i in range(self.n(1, 5)):
                if i:
                    pieces.append((r.choice([" "] * 6 + ["\n", "  "]), None))
                x = r.random()
                pieces += self.private() if x < 0.4 else [(self.decoy(), None)] if x < 0.58 else [(self.plain(), None)]
        text = "".join(p for p, _ in pieces)
        labels = np.concatenate([np.full(len(p), LABEL[k] if k else 0, np.int64) for p, k in pieces])
        dress = r.random()
        title = "".join(c.upper() if i and not text[i - 1].isalnum() else c for i, c in enumerate(text))
        loud = "".join(c.upper() if r.random() < 0.25 else c for c in text)
        # texts without personal data are dressed up more often, as their forms must not pass for names
        much = 1.0 if labels.any() else 2.0
        changed = text.upper() if dress < 0.06 * much else text.lower() if dress < 0.12 * much else loud if dress < 0.15 * much else title if dress < 0.21 * much else text
        if len(changed) == len(text):
            text = changed
        if r.random() < (0.05 if labels.any() else 0.35):  # other separators between words
            marks, rate = self.pick(["_"], ["-"], ["\t"], [", "], ["_", "-", ", ", "  ", "\t", "\u00a0"], ["\n"]), r.random()
            swapped = [r.choice(marks) if c == " " and r.random() < rate else c for c in text]
            labels = np.repeat(labels, [len(c) for c in swapped])
            text = "".join(swapped)
        if r.random() < 0.08:  # in quotes, brackets or a list
            before, after = self.pick(("'", "'"), ('"', '"'), ("(", ")"), ("* ", ""), ("**", "**"), ("\n", "\n\n"), ("- ", "..."), ("[retry 8] ", ""), ("“", "”"), ("", "!!"))
            text, labels = before + text + after, np.concatenate([np.zeros(len(before), np.int64), labels, np.zeros(len(after), np.int64)])
        if r.random() < 0.06:  # doubled spaces
            again = np.array([2 if c == " " and r.random() < 0.4 else 1 for c in text])
            text, labels = "".join(c * n for c, n in zip(text, again)), np.repeat(labels, again)
        return text, labels


class Batches:
    """``steps`` batches of windows (time, batch), made as they are asked for."""

    def __init__(self, steps: int, width: int = 128, length: int = 160, seed: int = 7, tokenizers: str | None = None):
        self.steps, self.width, self.length, self.maker = steps, width, length, Maker(seed, tokenizers)

    def __len__(self) -> int:
        return self.steps

    def window(self) -> tuple[np.ndarray, np.ndarray]:
        text, labels = self.maker.text()
        codes = encode(text)
        start = max(0, self.maker.n(-40, len(codes) - self.length + 40)) if len(codes) > self.length else 0
        start = min(start, max(0, len(codes) - self.length))
        codes, labels = codes[start : start + self.length], labels[start : start + self.length]
        pad = self.length - len(codes)
        return np.pad(codes, (0, pad)), np.pad(labels, (0, pad))

    def __iter__(self):
        for _ in range(self.steps):
            rows = [self.window() for _ in range(self.width)]
            yield np.stack([c for c, _ in rows], 1), np.stack([x for _, x in rows], 1).astype(np.int64)


def held_out(tagger: Tagger, n: int = 1500, seed: int = 991) -> dict[str, tuple[float, float]]:
    """Recall and precision by kind, over whole spans, on texts from another seed."""
    maker = Maker(seed)
    made = [maker.text() for _ in range(n)]
    found = tagger.label([t for t, _ in made])
    out = {}
    for kind, label in LABEL.items():
        gold = hit = said = right = 0
        for (text, labels), got in zip(made, found):
            got = np.zeros(len(text), np.int8) if got is None else got
            for a, b in spans(labels == label):
                gold += 1
                hit += (got[a:b] == label).mean() > 0.8
            for a, b in spans(got == label):
                said += 1
                right += (labels[a:b] == label).mean() > 0.8
        out[kind] = (hit / max(gold, 1), right / max(said, 1))
    return out


def spans(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def train(steps: int = 4000, hidden: int = 24, width: int = 128, seed: int = 7, report=None) -> Tagger:
    """A tagger from one process and the texts made here alone."""
    tagger = Tagger(hidden)
    tagger.fit(Batches(steps, width, seed=seed), report=report)
    return tagger


def train_wide(steps: int, tokenizers: str, hidden: int = 32, width: int = 128, seed: int = 7, processes: int = 8, report=None) -> Tagger:
    """The stored tagger: processes with seeds of their own, the mean of their gradients in each step."""
    tagger = Tagger(hidden)
    tagger.fit_side_by_side([Batches(steps + 1, width, seed=seed + i, tokenizers=tokenizers) for i in range(processes)], steps, 8e-3, report)
    return tagger


if __name__ == "__main__":
    began = time.time()

    def say(step: int, loss: float) -> None:
        if step % 200 == 0:
            print(step, round(loss, 5), round(time.time() - began), flush=True)

    model = train_wide(int(sys.argv[1]) if len(sys.argv) > 1 else 2600, sys.argv[2] if len(sys.argv) > 2 else "/opt/tokenizers", report=say)
    print(held_out(model), WINDOW)
    model.save(MODEL)
