"""Labelled sentences to fit the redactor: invented business notes with and without personal information."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

from paperloom.llm.names import GIVEN, fold
from paperloom.llm.personal import IBAN_LENGTH, luhn

# Invented sentences. {x} is an item of kind x, {x!} a look-alike, the rest fillers.
SENTENCES = """
Please call {person} on {phone} before noon.|Questions to {person}, tel. {phone}.|Phone: {phone}|Tel {phone}|Reach us at {email} or {phone}.|Mail {email}
Signed: {person}|Signed by {person} on {date}.|Attn: {person}|Contact: {person}, {email}|Contact: {person}|Bill To: {person}|{person} confirmed the amount of {money}.
Submitted by: {person}|Submitted by  {person}|Prepared by: {person}|Author: {person}|Approved by {person}, see {ref}.|Name: {person}|Customer: {person}|Loyalty member: {person}
Our courier met {person} at the door.|the guard saw {person} near the dock|Claim filed by {person} under {ref}.|For the seller: {person}, holder of {idno}.
Applicant's {idno} was checked by {dept}.|copy of {idno} attached, see {ref}|ID: {idno}|ID  {idno}|Identificación {idno}, vigente.|Passport check: {idno} valid until {date}.
Pay into {iban} quoting {ref}.|Account: {iban}|IBAN {iban}|Transferir a la cuenta {iban} a nombre de {person}.|Bitte auf {iban} überweisen.|Pay to {iban}
Card {credit_card}|Refund to card {credit_card}, approved by {person}.|card {credit_card} was charged {money}.|Paid with {credit_card}.|Tarjeta {credit_card} aceptada.
Address: {address}|Employee lives at {address}, mail {email}.|El solicitante vive en {address}.|Notices go to {address}, copy to {email}.|Home address on file: {address}.|Lieferung an {address} bis {date}.|Left with the neighbour at {address}; signed by {person}.|{person}, {address}|Parcel for {person}, {address}.
{person} <{email}>|{person} / {phone}|Emergency contact {person}, {phone}, {email}.|Enviar copia a {email} antes del {date}.|Remit advice to {email}.|Contactar a {person} al {phone} por el saldo de {money}.|Bitte an {person} weiterleiten, Tel. {phone}.|Cashier asked for {phone}|{person}|{address}|{phone}|Dear {person},|by telephone ({phone}).|Limit  {amount}
Deliver with {ref}; {n} @ {amount} each.|Counted {n} x {parts} brackets, {ref}.|Duplicate of {ref}, do not pay.|Payment matched against {ref} on {date}.|Price changed to {money} per the annex dated {date}.|Se recibió el pedido {ref} por {money}.|Rechnung {ref} über {money} geprüft.|Case ref: {ref}|Ref: {ref}
{company} asked {dept} for {n} extra copies.|{company} shipped {n} cartons; freight {money}.|Batch closed by {dept}, {n} lines open.|Approved without comment.|Stamp illegible, second scan requested.|{company}, {ref}|{company}|NIT: {nit}|{nit}|{nit}|Tax ID {nit}|This agreement is made on {date} between {company} and {company}.|Governing Law: State of {place}.|Total: {amount}|Subtotal: {amount}|{place}|Invoice No: INV-{n}|Invoice Date: {date}|Fees of {money}.|Term: {n} months.|Department: {dept}|{item}  {n}  {amount}|Factura No: FV-{n}|Form No: F-{n}|This invoice {ref} of {date} asks for {money} in total, tax of {amount} included.
SERVICES AGREEMENT|Contract No: MSA-{n}|RECEIPT R-{n}|APPLICATION FORM|Form No  F-{n}|TOTAL {money}|Total Due: {amount}|Annual Report|Executive Summary|Payment Terms: Net {n}|{dept}|{item}|Purchase Order {ref}|Approved by {dept}.|Contact {dept} before {date}.|{dept}, {place}|{place}, {date}|{company}, {place}
Sent to night shift on {date}.|Approved for late delivery.|Prepared by the team in {place}.|{company} {ref}|Vendor: {company}|Delivered to {place} on {date}.|Submitted by: {company}|Customer: {company}|Bill To: {company}
{masked} lives at {address}.|Emergency contact {masked}, {phone}.|Applicant's {masked2} was checked by {dept}.|Pay into {masked3} quoting {ref}.
"""

_SYLLABLES = [c + v for c in "bcdfghjklmnprstvwxyz" for v in "aeiou"]
_ENDINGS = ["", "", "", "n", "s", "r", "l", "x", "m", "nd", "rt", "th", "z", "ez", "son"]
# Family names, so that known ones count as well.
FAMILY = "Smith Jones García Müller Schmidt Weber López Martínez Rossi Dupont Moreau Brown Taylor Wilson Castillo Romero Vargas Becker Fischer Nowak Silva Costa Petit Laurent Keller Huber O'Brien Ortega Navarro Klein".split()
_TRADE = "Foods Logistics Hotel Apotheke Ceramics Textiles Energy Consulting Bakery Books Servicios Technologies Pharmaceuticals Manufacturing Engineering Packaging".split()
_LEGAL = "Ltd LLC GmbH AG Inc S.A. S.A.S. S.L. Co Corporation Cooperative".split()
_DEPT = ["Finance", "Legal", "Research", "Human Resources", "Quality", "Operations", "Compras", "Tesorería", "Warehouse", "Procurement"]
_MONTHS = "January February March April May June July August September October November December".split()


class _Writer:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.given = sorted(g for g in GIVEN)
        self.short = sorted({s for v in GIVEN.values() for s in v.split() if len(s) > 2})
        self.lines = [s for s in re.split(r"[|\n]", SENTENCES) if s]

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def word(self) -> str:
        if self.r.random() < 0.2:
            return self.r.choice(FAMILY)
        return self.made_up()

    def made_up(self) -> str:
        return ("".join(self.r.choice(_SYLLABLES) for _ in range(self.r.choice((2, 2, 3, 3)))) + self.r.choice(_ENDINGS)).capitalize()

    def person(self) -> tuple[str, int]:
        r = self.r
        known = r.random() < 0.5
        # a made-up given name stands for all those outside the list; hardly one comes twice
        given = (r.choice(self.given) if r.random() < 0.85 else r.choice(self.short)).capitalize() if known else self.made_up()
        if known and r.random() < 0.07:
            at = r.randrange(1, len(given))
            given = given[:at] + given[at - 1] + given[at:] if r.random() < 0.5 else given[:at] + given[at + 1 :]
        if r.random() < 0.1:
            given += " " + (r.choice(self.given).capitalize() if r.random() < 0.6 else self.made_up())
        middle = f" {r.choice('ABCDEFGHJKLMNPRSTUVWXYZ')}." if r.random() < 0.3 else ""
        family = self.word() + (r.choice((" ", " ", " ", "-")) + self.word() if r.random() < 0.5 else "")
        form = r.random()
        if form < 0.6:
            name = f"{given}{middle} {family}"
        elif form < 0.75:
            name = f"{given[0]}{r.choice(('.', '.', '.', '.', '')) if not middle else '.'}{middle} {family}"
        elif form < 0.88:
            name = f"{family}, {given}{middle}"
        elif form < 0.92:
            name = f"{family}, {given[0]}."
        else:
            name = f"{family} {given}{middle}"
        dress = r.random()
        name = name.upper() if dress < 0.12 else name.lower() if dress < 0.24 else name
        title = r.choice(("Mr ", "Ms. ", "Dr. ", "Sra. ", "Ing. ", "Herr ", "Prof. ")) if r.random() < 0.1 else ""
        return title + name, len(title)

    def phone(self) -> tuple[str, int]:
        d, r = self.digits, self.r
        area = f"{r.randrange(200, 999)}"
        return r.choice((
            f"({area}) {d(3)} {d(4)}", f"({area}) {d(3)}-{d(4)}", f"{area}-{d(3)}-{d(4)}", f"{area}.{d(3)}.{d(4)}", f"{area} {d(3)} {d(4)}", f"+1 ({area}) {d(3)}-{d(4)}", f"1 {area} {d(3)} {d(4)}",
            f"+34 {r.randrange(100, 999)} {d(2)} {d(2)} {d(2)}", f"+57 {d(3)} {d(3)} {d(4)}", f"+57{d(10)}", f"0049 {d(2)} {d(5)} {d(3)}", f"+49 (0){d(2)} {d(8)}", f"00 44 20 {d(4)} {d(4)}", f"+44 20 {d(4)} {d(4)}",
            f"+33 {r.randrange(1, 7)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+34{r.randrange(600, 799)}{d(6)}", f"{area} {d(2)} {d(2)} {d(2)}", f"+1{area}{d(7)}",
        )), 0

    def email(self) -> tuple[str, int]:
        r = self.r
        a, b = fold(self.word()), r.choice(self.given)
        user = r.choice((f"{b}.{a}", f"{b}-{a}", f"{a}_{b}", f"{b}+{a}", b[0] + a, f"{a}{self.digits(2)}", a)).replace("'", "")
        host = r.choice((a.replace("'", ""), "mail", "post", "correo", "example")) + "." + r.choice(("example", "test", "com", "invalid", "net", "org", "de", "es"))
        how = r.random()
        if how < 0.65:
            return f"{user}@{host}", 0
        if how < 0.75:
            return f"{user} @ {host}", 0
        return (f"{user} (at) {host}" if how < 0.88 else f"{user} [at] {host.replace('.', ' [dot] ')}"), 0

    def idno(self) -> tuple[str, int]:
        d, r = self.digits, self.r
        ssn = r.choice((f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", d(9)))
        cedula = r.choice((f"1{d(9)}", f"1.{d(3)}.{d(3)}.{d(3)}", f"{d(2)}.{d(3)}.{d(3)}", d(8)))
        passport = r.choice("ABCXZ") + r.choice("ABQRK") + d(7)
        return r.choice((
            ("SSN ", ssn), ("SSN: ", ssn), ("social security no. ", ssn), ("", f"{d(3)}-{d(2)}-{d(4)}"), ("national ID ", f"{d(6)}/{d(4)}"), ("national ID no. ", f"{d(6)}/{d(4)}"), ("passport ", passport), ("pasaporte no. ", passport),
            ("Reisepass ", passport), ("cédula ", cedula), ("cédula de ciudadanía ", cedula), ("C.C. ", cedula), ("CC No. ", cedula), ("DNI ", d(8) + "TRWAGMYF"[int(d(1)) % 8]), ("DNI: ", d(8) + "-" + "TRWAGMYF"[int(d(1)) % 8]), ("NIE ", f"X{d(7)}L"), ("Ausweis ", f"L{d(8)}"),
        ))

    def iban(self) -> tuple[str, int]:
        country = self.r.choice(sorted(IBAN_LENGTH))
        bank = "".join(self.r.choice("ABKQRS") for _ in range(4)) if country in ("NL", "GB", "IE") else ""
        body = bank + self.digits(IBAN_LENGTH[country] - 4 - len(bank))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        whole = f"{country}{check:02d}{body}"
        return (re.sub(r"(.{4})(?=.)", r"\1 ", whole) if self.r.random() < 0.5 else whole), 0

    def _card(self, right: bool) -> str:
        while True:
            n = self.r.choice(("4", "5", "4", "37")) + self.digits(14)
            n = n[:15]
            for last in "0123456789":
                if luhn(n + last):
                    n = n + (last if right else str((int(last) + self.r.randrange(1, 10)) % 10))
                    break
            return self.r.choice((n, re.sub(r"(.{4})(?=.)", r"\1 ", n), re.sub(r"(.{4})(?=.)", r"\1-", n)))

    def credit_card(self) -> tuple[str, int]:
        return self._card(True), 0

    def address(self) -> tuple[str, int]:
        d, r, w = self.digits, self.r, self.word
        n = str(r.randrange(1, 4999))
        return r.choice((
            f"{n} {w()} {r.choice(('Street', 'St.', 'Avenue', 'Blvd', 'Road', 'Lane', 'Court', 'Drive'))}" + r.choice(("", "", f", Apt {r.randrange(1, 40)}B", f", Unit {r.randrange(1, 90)}")),
            f"{r.randrange(1, 300)} rue {w()}", f"{r.randrange(1, 300)}, avenue de la {w()}", f"{r.choice(('Kr', 'Cra.', 'Carrera', 'Calle', 'Cl'))} {r.randrange(1, 190)} {r.choice(('No.', '#'))} {r.randrange(1, 99)}{r.choice(('', '', 'A', ' bis'))}{r.choice((' - ', '-'))}{r.randrange(1, 99)}",
            f"{r.choice(('Calle', 'Avenida', 'Av.', 'Paseo', 'Plaza'))} {w()} {n}" + r.choice(("", f", piso {r.randrange(1, 20)}")), f"{w()}{r.choice(('straße', 'gasse', 'weg', 'str.', 'allee'))} {r.randrange(1, 200)}", f"{w()}er Straße {r.randrange(1, 200)}",
            r.choice((f"{r.choice(('Via', 'Viale', 'Corso', 'Piazza', 'Rua', 'Travessa'))} {r.choice(('', '', 'della ', 'do '))}{w()}{r.choice((' ', ', '))}{r.randrange(1, 400)}", f"{r.randrange(1, 99)} {r.choice(('Piazza', 'Via', 'Rua'))} {w()}")),
        )), 0

    def ref(self) -> str:
        d, r = self.digits, self.r
        return r.choice((
            f"INV-20{d(2)}-{d(4)}", f"PO-20{d(2)}-{d(5)}", f"lot {d(8)}", f"Ref {d(3)}-{d(6)}-{d(1)}", f"Ref {d(3)}-{d(5)}-{d(1)}", f"{d(4)}/{d(2)}", f"item A{d(2)}.555.{d(2)}", f"tracking {self._card(False)}", f"tracking {self._card(self.r.random() < 0.1)}",
            f"order {d(10)}", f"parcel {d(12)}", f"case {d(6)}", f"contract {d(9)}", f"lot {d(3)}-{d(3)}-{d(4)}", f"ticket {d(7)}",
        ))

    def filler(self, name: str) -> str:
        d, r = self.digits, self.r
        amount = r.choice((f"{r.randrange(1, 999)}.{d(2)}", f"{r.randrange(1, 99)},{d(3)}.{d(2)}", f"{r.randrange(1, 99)}.{d(3)},{d(2)}", f"{r.randrange(1, 999)},{d(2)}"))
        y, m, day = r.randrange(2020, 2028), r.randrange(1, 13), r.randrange(1, 29)
        place = lambda: r.choice(("Villa ", "San ", "Port ", "Neu-", "")) + self.word()
        return {
            "ref": self.ref, "amount": lambda: amount, "n": lambda: str(r.randrange(1, 99)), "dept": lambda: r.choice(_DEPT), "place": place,
            "money": lambda: r.choice((f"{r.choice(('USD', 'COP', 'EUR'))} {amount}", f"{amount} EUR", f"COP {r.randrange(1, 99)}.{d(3)}.{d(3)}", f"USD {r.randrange(1, 9)},{d(3)}.{d(2)}", amount)),
            "date": lambda: r.choice((f"{y}-{m:02d}-{day:02d}", f"{day:02d}/{m:02d}/{y}", f"{_MONTHS[m - 1]} {day}, {y}", f"{day:02d}.{m:02d}.{y}")),
            "parts": lambda: f"{d(2)}-{d(2)}-{d(2)}", "nit": lambda: r.choice((f"8{d(2)}.{d(3)}.{d(3)}-{d(1)}", f"8{d(2)}.{d(3)}.{d(3)}-{d(1)}", f"9{d(2)}.{d(3)}.{d(3)}-{d(1)}", f"8{d(8)}-{d(1)}")), "item": lambda: r.choice(("Cold storage", "Toner black", "Café molido", "Bearing set")),
            "company": lambda: (lambda s: s.upper() if r.random() < 0.1 else s)(self.word() + r.choice((" ", " & ", " Weg ", " Avenue ", " Street ", " ")) + r.choice((self.word() + " ", "")) + r.choice(_TRADE) + " " + r.choice(_LEGAL)),
            "masked": lambda: "[REDACTED:person]", "masked2": lambda: "DNI [REDACTED:id_number]", "masked3": lambda: "[REDACTED:iban]",
        }[name]()

    def text(self) -> tuple[str, list[tuple[int, int, str]]]:
        out, truth, at = [], [], 0
        for _ in range(self.r.choice((1, 1, 2, 3, 4))):
            for part in re.split(r"(\{\w+\})", self.r.choice(self.lines)):
                name = part[1:-1] if part.startswith("{") else ""
                piece = part
                if name == "idno":
                    label, number = self.idno()
                    truth.append((at + len(label), at + len(label) + len(number), "id_number"))
                    piece = label + number
                elif name in ("person", "phone", "email", "iban", "credit_card", "address"):
                    piece, skip = getattr(self, name)()
                    truth.append((at + skip, at + len(piece), name))
                elif name:
                    piece = self.filler(name)
                out.append(piece)
                at += len(piece)
            gap = self.r.choice((" ", "\n", "\n", "\n\n"))
            out.append(gap)
            at += len(gap)
        return "".join(out), truth


def labelled_texts(number: int, seed: int) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)]) of `number` texts; the same for the same seed."""
    writer = _Writer(seed)
    for _ in range(number):
        yield writer.text()
