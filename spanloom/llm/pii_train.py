"""Fits the weights of ``pii``: ``python -m spanloom.llm.pii_train``.

The training texts are written here: sentence frames with typed slots, filled with made-up values, mixed with sentences
that only look as if they held personal information. None of the frames is taken from the project's tables, and every fourth
is held out, as are every fourth of the common names. The other names are made of syllables; a part of them is on the list of
known people, the others are not, so the model learns how far to trust the list, the sound of a word and its context.
Training maximises the conditional likelihood of the right segmentation over the candidate lattice (forward and backward
sums over text positions), by AdaGrad with L2 shrinkage. ``SENTENCES`` bounds the training set.
"""

from __future__ import annotations

import json
import math
import random
import re
from bisect import bisect_right

from spanloom.llm.pii import TYPES, WEIGHTS, People, candidates, common_words, decode

SENTENCES = 40_000
EPOCHS = 10
SEED = 7
#: Share of texts that are seen without half of the features of what stands around a span.
DROP = 0.4
#: Share of the slots of a frame that get other words before or after them, so that no wording is relied on.
AROUND = 0.2
_LOCAL = ("p1=", "p2=", "n1=", "n2=", "told", "first=", "next=", "side=")

_GIVEN = ["ada", "bel", "cor", "dam", "ela", "fio", "gre", "hal", "isk", "jor", "kar", "lio", "mir", "nad", "oli", "per", "qui", "ros", "sel", "tam", "uli", "val", "wen", "yor", "zel"]
_GIVEN_END = ["na", "ren", "bert", "line", "mar", "rik", "sa", "dor", "via", "nus", "la", "ton", "eth", "ius", "ira"]
_FAMILY = ["ander", "brom", "cald", "dorn", "eck", "fair", "gold", "harn", "ing", "kell", "lang", "mors", "nord", "oak", "pren", "rav", "sand", "thal", "under", "vent", "wald", "york", "zimm"]
_FAMILY_END = ["berg", "son", "ley", "wick", "feld", "escu", "elli", "ford", "stein", "owski", "aux", "mann", "ton", "ez", "dal", "hurst"]

# Frames: {N} name, {E} e-mail, {T} phone, {I} identity number with its word, {A} address, {C} place, {P} proper word, {W} word,
# {Dn} n digits, {F} filler. Every fourth frame of each list is held out: no weight is fitted on it.
FRAMES = [
    "Mr {N} and Ms {N} agreed.", "ask Mrs {N} or Mr {N}", "Please greet Dr {N}.", "Prof. {N} reads the draft.", "Das Konto von {N} ist gesperrt.", "Der Bericht von {N} fehlt noch.", "Frau {N} und Herr {N} sind da.", "Le compte de {N} est bloqué.", "La cuenta de {N} está cerrada.", "The request of {N} was heard.",
    "A note by {N} says otherwise.", "{N}'s badge expired.", "We miss {N}'s signature.", "{N} played with {N}.", "{N} and {N} won.", "Yesterday {N} dropped by.", "for {N}", "with {N}", "{N}", "{N} (absent)", "room of {N}", "{N} agrees, {N} does not.", "Passengers: {N} / {N}", "{N} / {N} / {N}", "Rooms for {N} and {N}", "on behalf of {N}",
    "The bill for {A} is open.", "Nobody answered at {A} or {A}.", "Heating at {A} failed twice.", "the boxes for {A} arrived", "from {A} to {A}", "Der Brief an {A} kam an.", "La lettre pour {A} est partie.", "El recibo de {A} llegó.", "The dossier of {N} is thin.", "Le courrier de {N} est là.", "La carta de {N} llegó.",
    "{E};{T};{N}", "{T};{E}", "{D4};{N};{T};{A}", "{N}, {N} and {N} share it", "Desks 3 and 9: {N} and {N}.", "They sat beside {N} and {N}.", "Hand it to {N} or to {N}.", "{T} works best, {T} never.", "{T} is my line.", "use {T} instead", "{E} is fine", "{A} is where I grew up.",
    "My colleague {N} can take this over.", "The tenant, {N}, has a new number: {T}.", "Could you add {N} to the list?", "I am {N} and write on behalf of my mother {N}.", "This is {N} from accounts.", "{N} is on leave until Monday.",
    "Talk to {N} before you sign.", "Prepared by {N}, checked by {N}.", "{N} wrote to us from {E} yesterday.", "Minutes taken by {N}", "Present: {N}, {N}, {N}", "Witness {N} saw the van outside {A}.", "Emergency contact: {N} ({T})",
    "Thank you for your help, {N}", "Yours sincerely, {N}", "Cheers, {N}", "Dr {N} will see you at nine.", "Mrs {N} left her glasses here.", "Mr. {N} rang twice about the heating.", "Guest: {N}, arriving late", "The invoice goes to {N}, {A}.",
    "Owner {N} lives in {A}.", "Assigned to: {N}", "reviewer={N} status=open", "name: {N}, phone: {T}, mail: {E}", "\"name\": \"{N}\", \"phone\": \"{T}\"", "{N},{T},{E}", "{N} | {E} | {A}", "applicant {N} {F} {I}", "I met {N} and her brother {N} at the fair.",
    "{N} told me that {F} was late.", "We forwarded it to {N} because {F} asked for it.", "As {N} said, {F} is fine.", "Has {N} paid?", "Only {N} knows the combination.", "According to {N} the {W} is broken.", "please tell {N} that i am ill", "thx {N} see u tomorrow",
    "hey {N} can you ring {T}", "i am {N} and i live at {A}", "Speaker {N}: good morning everyone.", "Author: {N} <{E}>", "Reply-To: {E}", "Forward everything to {E} please.", "{E} bounced again.", "Her new mailbox is {E} and the old one {E} is closed.",
    "Sign in with {E} or call {T}.", "mailto:{E}", "E-mail: {E}", "Contact {E} for a copy.", "You will find me under {E}.", "copy to {E}, thanks", "My cell is {T}.", "Ring {T} and ask for {N}.", "Phone: {T}", "Fax: {T}", "Mobile {T}, home {T}",
    "call me back at {T} when you can", "If nobody answers try {T}.", "They dialled {T} by mistake.", "text {T} with the word {W}", "WhatsApp {T}", "our hotline is {T}", "Tel.: {T}", "Office {T} or mobile {T}", "Telefon {T}", "Sie erreichen mich unter {T}.",
    "Handy: {T}", "Frau {N} ist unter {T} erreichbar.", "Herr {N} hat sich gemeldet.", "Ansprechpartner ist {N}.", "Mit freundlichen Grüßen {N}", "Unser Kunde {N} wohnt in der {A}.", "Die Adresse lautet {A}.", "Lieferung an {N}, {A}, bitte klingeln.",
    "Seine Ausweisdaten: {I}", "Monsieur {N} n'a pas répondu.", "Appelez {N} au {T}.", "Mme {N} demeurant {A}", "J'ai écrit à {E} sans succès.", "Merci, {N}", "Livraison au {A} demain.", "La cliente {N} a fourni {I}.", "Estimada señora {N}:", "Llame a {N} al {T}.",
    "El cliente {N} vive en {A}.", "Envíe la copia a {E}.", "Firmado: {N}", "Her {I} was copied from the card.", "Please verify {I} before boarding.", "{I} belongs to {N}.", "The officer noted {I} and {I}.", "Holder: {N}, {I}", "We need your {I} for the form.",
    "The clerk typed {I}.", "ID check done: {I}", "Applicant gave {I} and lives at {A}.", "my {I} if you need it", "With {I} she could register.", "Deliver to {A} after six.", "She moved out of {A} in spring.", "The van stopped at {A}.", "Our office is at {A}, next to the bank.",
    "Home address: {A}", "Billing address {A}", "Visit us: {A}", "{A} is being repainted.", "Pick it up from {A}, second floor.", "The leak is in {A}.", "residing at {A}", "Send the keys to {N} at {A}.", "address={A};phone={T}", "between {A} and {A}",
]
# Sentences without personal information.
PLAIN = [
    "{P} {P} was once called {P}.", "The name {P} {P} is reserved.", "{P} {P}, formerly {P}, is a {W}.", "{P} {P}", "{P} {P} is down", "{P} {P} and {P} {P} merged.", "for {P} {P} only", "the {P} {P}", "{P} {P} has a new name.", "{F} and {F}", "{P}, {P} and {P}", "{P}, {P}", "The {P} {P} plan was approved.", "{P} {P} is a quiet place.", "Read the {P} Guide first.", "The {P} {P} Company opened a shop in {C}.", "Our {P} {P} newsletter is out.", "We watched {P} {P} at the cinema.", "Deep {P} models need data.", "The New {P} branch is closed.",
    "Greetings from the {P} {P} crew", "Dear {P} members, see below.", "Hello {P} {P} users!", "Project {P} {P} starts in June.", "The {P} Museum shows {P} {P}.", "By {P} Bridge turn left.", "Tour de {P} passes {C}.", "{C} and {C} are twin towns.", "The train from {C} to {C} was late.",
    "{P} {W} and {P} {W} differ.", "On Tuesday {P} {P} was offline.", "Sign the {P} {P} form.", "with {P} {P} support", "from {P} {P} to {P} {P}", "signed by the {P} {P} board", "Contact the {P} Desk.", "customer of {P} {P} Ltd", "{F}", "{F} {F}.", "the {W} of the {W}", "{W} {W} {W}",
    "Case {D5}/{D2} is closed.", "Order number {D3}-{D5}", "Invoice {D8} is unpaid.", "Tracking {D4} {D4} {D4}", "SKU {D6}", "Lot {D3}-{D3}-{D4}", "Article {D4}-{D4}", "Voucher {P2}{D8}", "Build {D1}.{D1}.{D3}", "upgrade to {D2}.{D2}.{D2}", "The sensor read {D3}.{D2} at {D2}:{D2}:{D2}.",
    "Date 20{D2}-0{D1}-1{D1}", "due on 1{D1}.0{D1}.20{D2}", "Total {D3}.{D2} EUR", "{D2}.{D3}.{D3} units", "1{D2} of {D3} rows", "from {D4} to {D4}", "lines {D3}-{D3}", "ports {D4}, {D4} and {D4}", "address 10.{D3}.{D2}.{D1}", "subnet 192.168.{D1}.{D1}/{D2}", "host {W}-{D2}.{W}.example is up",
    "hash {H}", "sha {H}{H}", "digest {D9}b{D2}", "digest c{D10}", "token {D12}", "key {P2}-{D3}-{D4}", "Checksum {D11}d", "Checksum {D7}e{D4}", "Claim {D5}-{D3}", "ISBN {D3}-{D1}-{D5}-{D3}-{D1}", "model {P2}{D3}", "Gate {P2} {D3}", "plate {P2} {D4}", "part {D3}-{D2}-{D4}{D1}", "serial no {D4} {D4} {D2}",
    "The index rose {D2} points.", "version {D1}.{D2} of {P}", "code {D3} {D4}", "code {D4}-{D4}", "entry {D4} {D5} of the table", "the number {D5} {D3} on the box is a batch", "Position {D3}.{D3}, {D3}.{D3}", "at {D2} dot {D2}", "meet at the dot on the map", "pip install {W}@{D1}.{D1}", "npm {W}@{D2}.{D1}.{D1} failed",
    "image {W}@sha256 pulled", "ping @{W} in the channel", "@{W} please look", "{W}@{D1}.{D2}.{D3}", "5 {P} Way projects", "{D2} open {W} tickets", "{D1} drive failures", "route {D2} is closed", "in {D2} places", "the {D1}th street festival", "{D2} {W} court cases", "{D3} {P} St pupils", "room {D3} {P} Place Hotel",
    "He ran {D2} {W} way ahead.", "Ring {D1} of the cluster", "way {D2}", "La {P} {P} abre a las {D1}.", "Le {P} {P} ferme à {D2} h.", "Das {P} {P} bleibt zu.", "The weather in {C} is mild.", "Sent {D3} copies of {P} {P}.", "Ticket {D6} for {P} {P}", "User {W}{D3} logged in.", "session {H} ended", "Passport control is closed.",
    "The phone line is dead.", "Social security reform passed.", "The street was empty.", "Names are checked later.", "Mail is slow today.", "Call volume rose by {D2} percent.", "Identity cards are not accepted.", "The card reader shows {D4}.", "policy {D6} was renewed", "loan {D3}{D5}",
]
HELD_OUT = 4


def _split(frames: list[str], held_out: bool) -> list[str]:
    return [f for i, f in enumerate(frames) if (i % HELD_OUT == HELD_OUT - 1) == held_out]


_PLACES = ["Norwald", "Esker", "Tolmin", "Brightsea", "Karsund", "Velmora", "Ashcombe", "Riverton", "Lindau", "Montclar", "Porto Nuvo", "San Telmo", "Eastmere", "Wexham"]
_PROPER = ["Garden", "Winter", "Orbit", "Maple", "Summit", "Granite", "Meadow", "Falcon", "Signal", "Crystal", "Great", "Velvet", "Anchor", "Beacon", "Cedar", "Delta", "Ember", "Prairie", "Quartz", "Zephyr"]
_WORDS = ["server", "window", "printer", "camera", "report", "budget", "garden", "battery", "signal", "storage", "engine", "review", "paper", "bridge", "market", "engineer"]
_STREET = ["Juniper", "Hollow", "Old Mill", "Lower Brook", "Saint Aldwin", "Cobbler", "Rosedale", "Fern", "Ash", "Long Meadow", "Windy", "Gilder", "Bishop", "High Gable", "Station", "kestle", "orchard"]
_TYPES = ["Street", "St.", "St", "Road", "Rd", "Avenue", "Ave", "Ave.", "Lane", "Ln", "Drive", "Dr", "Court", "Ct", "Blvd", "Boulevard", "Way", "Terrace", "Place", "Close"]
# Names of people as they are common in several countries; every fourth is held out.
_REAL_GIVEN = "Grace Mark Rose Will Maria Hans Priya Tomasz Ana Luis Fatima Chen Olga Ivan Pierre Ingrid Kofi Yuki Mary James Linda Robert Susan Peter Karen Ahmed Leila Nina Pavel Marta Jean Luc Elena Sven Aisha David Laura Omar Zoe Hugo".split()
_REAL_FAMILY = "Brown Young Baker Green Gonzalez Müller Raman Wojcik Silva Garcia Hassan Wei Petrova Sokolov Dubois Berg Mensah Tanaka Smith Novak Jones Taylor King Wood Hill Fischer Weber Schmidt Rossi Costa Martin Moreau Kowalska Hansen Nguyen Patel Kim Ali Lopez Bell".split()
_FILLER = "the whole thing|somebody else|most of it|our second shift|a new part|the old plan|what we agreed|the last one|nobody here|some of the files|another look|the usual way|a short break|all of us|the next step|my own view".split("|")
_DE = ["Linden", "Mühlgraben", "Kupfer", "Ost", "Rosen", "Berg", "Schul", "Garten", "Fähr", "Birken"]
_DE_END = ["straße", "strasse", "weg", "gasse", "allee", "platz", "ring", "ufer"]
_FR = ["du Vieux-Pont", "de la Forge", "des Tilleuls", "des Ormes-Gris", "du Moulin", "de Verdure", "des Cygnes", "de la Gare"]
_FR_TYPE = ["rue", "avenue", "boulevard", "allée", "chemin", "place", "quai"]
_DOMAINS = ["harbor-clinic.example", "fernwood.test", "mail.birch.example", "inbox.grey.test", "kestle-post.invalid", "oakmail.example", "post.example.org", "uni-nord.example", "web.de", "corp.co.uk"]
_ID_WORDS = {
    "ssn": ["SSN", "SSN:", "ssn", "ssn on file", "social security number", "social security no.", "social"], "nino": ["NI number", "national insurance no", "national insurance number"],
    "doc": ["passport", "passport no.", "travel document", "passport number", "Reisepass"], "card": ["identity card", "national id", "Ausweisnummer", "ID card no", "identity card number", "carte d'identité", "DNI"],
}


def _d(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


class Writer:
    def __init__(self, seed: int, held_out: bool = False):
        self.r = random.Random(seed)
        self.around = 0.0 if held_out else AROUND
        self.frames, self.plain = _split(FRAMES, held_out), _split(PLAIN, held_out)
        self.real = _split(_REAL_GIVEN, held_out), _split(_REAL_FAMILY, held_out)
        r = self.r
        given = [a + b for a in _GIVEN for b in _GIVEN_END]
        family = [a + b for a in _FAMILY for b in _FAMILY_END]
        r.shuffle(given), r.shuffle(family)
        self.given, self.family = given[:220], family[:220]
        known = lambda xs: [x.capitalize() for x in xs[: len(xs) * 6 // 10]]
        self.capital = [w.capitalize() for w in sorted(common_words()) if 3 < len(w) < 9 and w.isascii() and w not in {x.lower() for x in _REAL_GIVEN + _REAL_FAMILY}]
        self.common = sorted(w for w in common_words() if len(w) > 1 and w not in {x.lower() for x in _REAL_GIVEN + _REAL_FAMILY})
        self.people = People(known(self.given), known(self.family), common_words())

    def name(self) -> str:
        r = self.r
        g, f = r.choice(self.given).capitalize(), r.choice(self.family).capitalize()
        if (k := r.random()) < 0.25:
            g, f = r.choice(self.real[0]), r.choice(self.real[1])
        elif k < 0.35:
            g, f = r.choice([(g, r.choice(self.real[1])), (r.choice(self.real[0]), f)])
        k = r.random()
        if k < 0.06:
            f = "O'" + f
        elif k < 0.10:
            f = r.choice(["de ", "van ", "von "]) + f
        elif k < 0.15:
            f = f + "-" + r.choice(self.family).capitalize()
        k = r.random()
        if k < 0.50:
            return f"{g} {f}"
        if k < 0.62:
            return f"{f}, {g}"
        if k < 0.72:
            return f"{f.upper()} {g}"
        if k < 0.80:
            return f"{g} {g2} {f}" if (g2 := r.choice("ABCDEFGHIJKLMNOPRSTUVWZ") + ".") else ""
        if k < 0.87:
            return f"{r.choice('ABCDEFGHIJKLMNOPRSTUVWYZ')}. {f}"
        if k < 0.95:
            return r.choice([f"{g} {f}", f"{g} {f}", f"{f}, {g}"]).lower()
        return f"{g} {f}".upper()

    def email(self) -> str:
        r = self.r
        g, f = r.choice(self.given), r.choice(self.family)
        local = r.choice([f"{g}.{f}", f"{g[0]}{f}", f"{g}{_d(r, 2)}", f"{f}_{g}", f"{g}.{f}+{r.choice(_WORDS)}", f"{g}-{f}"])
        at, dot = r.choice([("@", "."), ("@", "."), ("@", "."), ("@", "."), ("@", "."), ("@", "."), (" (at) ", "."), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", "(dot)")])
        s = local + at + r.choice(_DOMAINS).replace(".", dot)
        return s.upper() if r.random() < 0.08 else s

    def phone(self) -> str:
        r = self.r
        a, b, c = _d(r, 3), _d(r, 3), _d(r, 4)
        s = r.choice([
            f"({a}) {b}-{c}", f"{a} {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 {a} {b} {c}", f"1{a}{b}{c}", f"+1-{a}-{b}-{c}", f"+44 20 {c} 0{b}", f"020 {c} 0{b}", f"01{a} {_d(r, 6)}", f"+49 30 {_d(r, 5)} {b}",
            f"+49 {a} {_d(r, 7)}", f"0{_d(r, 1)} {_d(r, 2)} {_d(r, 2)} {_d(r, 2)} {_d(r, 2)}", f"+33 {_d(r, 1)} {_d(r, 2)} {_d(r, 2)} {_d(r, 2)} {_d(r, 2)}", f"+34 {a} {b} {a}", f"0{a}/{_d(r, 6)}", f"+48 {a} {b} {a}",
        ])
        return s + (f" ext. {_d(r, 2)}" if r.random() < 0.1 else "")

    def identity(self) -> tuple[str, str]:
        r = self.r
        kind = r.choice(["ssn", "ssn", "ssn", "nino", "doc", "card"])
        if kind == "ssn":
            a, b, c = _d(r, 3), _d(r, 2), _d(r, 4)
            v = r.choice([f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}{b}{c}"])
        elif kind == "nino":
            p = "".join(r.choice("ABCEHJKLQ") for _ in range(2))
            v = r.choice([f"{p}{_d(r, 6)}{r.choice('ABCD')}", f"{p} {_d(r, 2)} {_d(r, 2)} {_d(r, 2)} {r.choice('ABCD')}"])
        elif kind == "doc":
            v = r.choice([f"{r.choice('CFGHXYZ')}{_d(r, 8)}", f"{r.choice('CFGHXYZ')}{r.choice('AB')}{_d(r, 7)}", _d(r, 9)])
        else:
            p = "".join(r.choice("ABCDXYZ") for _ in range(2))
            v = r.choice([f"{p}{_d(r, 3)}.{_d(r, 3)}.{_d(r, 3)}-{_d(r, 2)}", f"{p}{_d(r, 9)}", f"{_d(r, 8)}{r.choice('ABCZ')}"])
        return r.choice(_ID_WORDS[kind]) + " ", v

    def address(self) -> str:
        r = self.r
        n = _d(r, r.choice([1, 2, 3, 3])).lstrip("0") or "7"
        k = r.random()
        if k < 0.55:
            s = f"{n}{r.choice(['', '', '', 'A', 'B'])} {r.choice(_STREET)} {r.choice(_TYPES)}"
            s = s.lower() if r.random() < 0.08 else s
            return s + (f", Flat {_d(r, 2)}" if r.random() < 0.15 else "")
        if k < 0.75:
            s = f"{r.choice(_DE)}{r.choice(_DE_END)} {n}"
            return s.lower() if r.random() < 0.08 else s
        if k < 0.82:
            return f"{r.choice(['Am', 'Im', 'An der', 'Zum', 'Unter den'])} {r.choice(['Alten Wall', 'Neuen Wehr', 'Hang', 'Grünen Tor', 'Linden'])} {n}"
        return f"{n}{r.choice(['', ','])} {r.choice(_FR_TYPE)} {r.choice(_FR)}"

    def words(self) -> str:
        """One to four words: common ones of several languages, and rare ones made of their pieces."""
        r, out = self.r, []
        for _ in range(r.randrange(1, 5)):
            w = r.choice(self.common)
            if r.random() < 0.3:
                w = w[: max(2, len(w) // 2 + 1)] + r.choice(self.common)[-4:]
            out.append(w)
        return " ".join(out)

    def proper(self) -> str:
        """A proper word: of common words mostly, but names of people and words never heard are used so too."""
        r = self.r
        k = r.random()
        if k < 0.4:
            return r.choice(_PROPER)
        if k < 0.78:
            return r.choice(self.capital)
        if k < 0.92:
            return (r.choice(self.capital)[:4] + r.choice(self.common)[-4:]).capitalize()
        return r.choice(self.real[1]) if k < 0.96 else r.choice([r.choice(self.given), r.choice(self.family)]).capitalize()

    def fill(self, frame: str) -> tuple[str, list[tuple[int, int, str]]]:
        r, out, gold, at = self.r, [], [], 0
        for part in re.split(r"(\{\w+\})", frame):
            label = None
            if part.startswith("{") and r.random() < self.around:
                w = self.words() + " "
                out.append(w)
                at += len(w)
            if part == "{N}":
                part, label = self.name(), "name"
            elif part == "{E}":
                part, label = self.email(), "email"
            elif part == "{T}":
                part, label = self.phone(), "phone"
            elif part == "{A}":
                part, label = self.address(), "street_address"
            elif part == "{I}":
                word, part = self.identity()
                out.append(word)
                at += len(word)
                label = "identity_number"
            elif part == "{C}":
                part = r.choice(_PLACES)
            elif part == "{P}":
                part = self.proper()
            elif part == "{P2}":
                part = "".join(r.choice("ABCDEFGHKLMNPQRSTWXYZ") for _ in range(2))
            elif part == "{F}":
                part = r.choice(_FILLER)
            elif part == "{W}":
                part = r.choice(_WORDS)
            elif part == "{H}":
                part = "".join(r.choice("0123456789abcdef") for _ in range(12))
            elif m := re.fullmatch(r"\{D(\d+)\}", part):
                part = _d(r, int(m[1]))
            if label:
                gold.append((at, at + len(part), label))
                if r.random() < self.around and not part.endswith("."):
                    out.append(part)
                    at += len(part)
                    part = " " + self.words()
            out.append(part)
            at += len(part)
        return "".join(out), gold

    def text(self) -> tuple[str, list[tuple[int, int, str]]]:
        """One to four sentences, a third of them with personal information."""
        r = self.r
        text, gold = "", []
        for _ in range(r.choice([1, 1, 2, 3, 4])):
            s, g = self.fill(r.choice(self.frames if r.random() < 0.5 else self.plain))
            if text:
                text += r.choice([" ", " ", " ", "\n"])
            gold += [(a + len(text), b + len(text), c) for a, b, c in g]
            text += s
        if r.random() < 0.15:
            s = self.fill(r.choice(self.plain))[0]
            text += f" {s[: r.randrange(4, len(s))]}...[truncated]"
        return text, gold


def _examples(writer: Writer, n: int) -> list[tuple[list[tuple[int, int, str, list[str]]], set[tuple[int, int, str]]]]:
    out = []
    for _ in range(n):
        text, gold = writer.text()
        cands = [(c.start, c.end, label, c.features) for c in candidates(text, writer.people) for label in c.labels]
        out.append((sorted(cands, key=lambda c: (c[1], c[0])), _aligned(cands, gold)))
    return out


def _aligned(cands: list[tuple], gold: list[tuple[int, int, str]]) -> set[tuple[int, int, str]]:
    """The candidate that is the entity: the same span, or the one that differs from it by a mark at an end."""
    out = set()
    for a, b, t in gold:
        near = sorted((abs(c[0] - a) + abs(c[1] - b), c[0], c[1]) for c in cands if c[2] == t and abs(c[0] - a) + abs(c[1] - b) <= 1)
        if near:
            out.add((near[0][1], near[0][2], t))
    return out


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -1e300 else a


def marginals(segments: list[tuple[int, int, float]]) -> list[float]:
    """Probability of each segment (sorted by end) under the field; the outside scores 0."""
    n = len(segments)
    ends = [s[1] for s in segments]
    fwd = [0.0]  # log sum over segmentations of what ends at or before the end of segment i - 1
    before = []
    for i, (start, _, score) in enumerate(segments):
        j = bisect_right(ends, start, 0, i)
        before.append(j)
        fwd.append(_log_add(fwd[i], fwd[j] + score))
    # backward by start position
    order = sorted(range(n), key=lambda i: -segments[i][0])
    starts = [-segments[i][0] for i in order]
    bwd = [0.0]
    after = [0] * n
    for k, i in enumerate(order):
        j = bisect_right(starts, -segments[i][1], 0, k)
        after[i] = j
        bwd.append(_log_add(bwd[k], bwd[j] + segments[i][2]))
    z = fwd[n]
    return [math.exp(min(0.0, fwd[before[i]] + segments[i][2] + bwd[after[i]] - z)) for i in range(n)]


def train(sentences: int = SENTENCES, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, dict[str, float]]:
    data = _examples(Writer(seed), sentences)
    data = [x for x in data if x[0]]
    w: dict[str, dict[str, float]] = {t: {} for t in TYPES}
    g2: dict[str, dict[str, float]] = {t: {} for t in TYPES}
    r = random.Random(seed)
    for epoch in range(epochs):
        r.shuffle(data)
        for cands, gold in data:
            drop = r.random() < DROP  # so that no single word beside a span is relied on
            if drop:
                cands = [(a, b, t, [f for f in fs if not f.startswith(_LOCAL) or r.random() < 0.5]) for a, b, t, fs in cands]
            segs = [(a, b, sum(w[t].get(f, 0.0) for f in fs)) for a, b, t, fs in cands]
            for (a, b, t, fs), p in zip(cands, marginals(segs)):
                d = ((a, b, t) in gold) - p
                if abs(d) < 1e-3:
                    continue
                wt, gt = w[t], g2[t]
                for f in fs:
                    x = wt.get(f, 0.0)
                    g = d - 1e-4 * x
                    h = gt[f] = gt.get(f, 0.0) + g * g
                    wt[f] = x + 0.3 * g / (0.1 + math.sqrt(h))
    return {t: {f: round(x, 4) for f, x in sorted(w[t].items()) if abs(x) > 0.03} for t in TYPES}


def accuracy(model: dict[str, dict[str, float]], n: int = 2000, seed: int = 99) -> dict[str, tuple[float, float]]:
    """Precision and recall by exact span and type on held-out texts: other frames, other names, other values."""
    writer = Writer(seed, held_out=True)
    hit, said, there = ({t: 0 for t in TYPES} for _ in range(3))
    for _ in range(n):
        text, gold = writer.text()
        segs = [(c.start, c.end, t, sum(model[t].get(f, 0.0) for f in c.features)) for c in candidates(text, writer.people) for t in c.labels]
        for g in decode(segs):
            said[g[2]] += 1
            hit[g[2]] += g in gold
        for g in gold:
            there[g[2]] += 1
    return {t: (hit[t] / max(said[t], 1), hit[t] / max(there[t], 1)) for t in TYPES}


if __name__ == "__main__":
    model = train()
    WEIGHTS.write_text(json.dumps(model, indent=0, ensure_ascii=False) + "\n")
    print({t: len(f) for t, f in model.items()}, accuracy(model))
