"""Other names of the entries of the reference lists; a table the caller passes to map_values, to be kept with the lists."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Other names of the entries, by field and canonical value. {n} stands for the number in a
# canonical value of the form 'Net n', {w} and {s} for that number in words, English and Spanish.
OTHER_NAMES = {
    "payment_method": {
        "cash": [
            "efectivo", "en efectivo", "dinero en efectivo", "paid in cash", "cash payment", "notes and coins", "bar", "bar bezahlt",
            "barzahlung", "espèces", "contado", "al contado", "bargeld", "en espèces",
        ],
        "card": [
            "credit card", "debit card", "plastic card", "contactless card", "pos card", "chip and pin", "tc", "t. crédito", "tarjeta",
            "tarjeta de crédito", "tarjeta de débito", "tarj. débito", "tarj. crédito", "kreditkarte", "carte bancaire",
            "card ending 0000", "visa", "mastercard", "amex", "ec-karte", "karte",
        ],
        "transfer": [
            "bank transfer", "tranfer", "wire", "wire transfer", "eft", "trf", "bank giro", "sepa transfer", "transferencia",
            "transf. bancaria", "transferencia bancaria", "consignación bancaria", "überweisung", "virement", "banküberweisung",
            "virement bancaire",
        ],
        "cheque": [
            "check", "chq", "chk no. 0000", "paid by check", "paid by cheque", "bank cheque", "bank check", "cheque de gerencia", "scheck",
            "chèque",
        ],
        "direct debit": [
            "dd", "sepa dd", "lastschrift", "domiciliación", "domiciliación bancaria", "débito automático", "autopay debit",
            "direct-debit mandate", "prélèvement",
        ],
        "mobile wallet": [
            "wallet", "e-wallet", "phone wallet", "qr wallet", "paid by phone app", "billetera móvil", "monedero digital",
            "billetera digital", "apple pay", "google pay",
        ],
        "gift card": [
            "giftcard", "gift voucher", "voucher", "store voucher", "bono regalo", "tarjeta regalo", "gutschein", "geschenkkarte",
            "carte cadeau",
        ],
        "money order": ["m.o.", "postal order", "postal money order", "giro postal", "postanweisung", "mandat postal"],
    },
    "currency": {
        "USD": [
            "$", "us$", "us dollar", "us dollars", "u.s. dollar", "u.s. dollars", "u.s.d.", "american dollars", "american dollar",
            "dólares americanos", "dólar americano", "dolares eeuu", "usd (dollars)", "us dolar", "dólares",
        ],
        "EUR": ["€", "eur€", "euro", "euros", "euro(s)", "e.u.r."],
        "COP": ["col$", "cop$", "colombian pesos", "colombian peso", "peso col.", "col. peso", "pesos colombianos", "pesos (colombia)", "c.o.p."],
        "GBP": [
            "£", "sterling", "stg", "pounds sterling", "pound sterling", "british pound", "british pounds", "uk pounds",
            "libras esterlinas", "g.b.p.", "gb£",
        ],
        "MXN": ["mx$", "mex$", "mexican pesos", "mexican peso", "pesos mexicanos", "peso mex.", "m.n. (méxico)", "m.x.n."],
        "CAD": [
            "c$", "ca$", "cdn$", "cad$", "canadian dollars", "canadian dollar", "can. dollars", "dólar canadiense", "dólares canadienses",
            "c.a.d.",
        ],
        "BRL": ["r$", "brazilian real", "brazilian reais", "reais", "real (br)", "reales brasileños", "b.r.l."],
        "CLP": ["clp$", "chilean pesos", "chilean peso", "peso chil.", "pesos chilenos", "c.l.p.", "ch$"],
        "PEN": ["s/", "s/.", "soles", "sol", "nuevos soles", "sol peruano", "soles peruanos", "peruvian soles", "peruvian sol", "p.e.n."],
        "ARS": ["ar$", "argentine pesos", "argentine peso", "peso arg.", "pesos argentinos", "a.r.s."],
        "JPY": ["¥", "jp¥", "yen", "yenes", "japanese yen", "j.p.y."],
        "CHF": ["sfr.", "fr. (ch)", "franken", "swiss francs", "swiss franc", "francos suizos", "schweizer franken", "c.h.f."],
    },
    "payment_terms": {
        "Due on receipt": [
            "dor", "d.o.r.", "upon receipt", "on receipt", "pay on receipt", "payable when received", "immediate payment",
            "due immediately", "sofort fällig", "pago inmediato", "payable at once",
        ],
        "Cash on delivery": [
            "cod", "c.o.d.", "collect on delivery", "pay on delivery", "contra entrega", "pago contra entrega", "nachnahme",
            "per nachnahme",
        ],
        "End of month": [
            "eom", "e.o.m.", "due eom", "month end", "at end of the month", "fin de mes", "a fin de mes", "monatsende", "zum monatsende",
        ],
        "Prepaid": [
            "pia", "p.i.a.", "pre-paid", "pre-paid in full", "prepaid in full", "payment in advance", "advance payment",
            "cash before shipment", "pago anticipado", "anticipado", "vorkasse", "vorauskasse", "paid in advance",
        ],
        "2/10 Net 30": [
            "2/10", "2/10 net30", "2/10, n/30", "2-10-30", "2 pct 10 days / 30 net", "2% discount within 10 days, otherwise 30",
            "2% 10, net 30", "2/10 n30",
        ],
        "Net n": [
            "n{n}", "n/{n}", "net-{n}", "net{n}", "{n}d", "{n} d", "net {n} d.", "net {n} days", "{n} days", "{n} days net",
            "net {n} days from invoice", "due in {n} days", "payable within {n} days", "{n} días", "a {n} días", "pago a {n} dias",
            "{n} tage", "{n} tage netto", "netto {n} tage", "zahlbar in {n} tagen", "{w} days", "{s} días",
        ],
    },
}

# Numbers in words, English and Spanish.
NUMBER_WORDS = {
    7: ("seven", "siete"),
    10: ("ten", "diez"),
    15: ("fifteen", "quince"),
    30: ("thirty", "treinta"),
    45: ("forty-five", "cuarenta y cinco"),
    60: ("sixty", "sesenta"),
    90: ("ninety", "noventa"),
}


def other_names(field: str, canonical: str) -> list[str]:
    """The other names of one entry; those of 'Net n' are written for each number."""
    known = OTHER_NAMES.get(field, {})
    names = list(known.get(canonical, ()))
    head, _, number = canonical.partition(" ")
    if head.lower() == "net" and number.isdigit():
        words = NUMBER_WORDS.get(int(number), ("", ""))
        for form in known.get("Net n", ()):
            if ("{w}" not in form or words[0]) and ("{s}" not in form or words[1]):
                names.append(form.format(n=int(number), w=words[0], s=words[1]))
    return names


def other_name_table(reference: DataFrame) -> DataFrame:
    """(ref_id, name) for the entries of a reference list that other names are known of."""

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, n) for i, f, c in zip(batch["ref_id"], batch["field"], batch["canonical"]) for n in other_names(f, c)]
            yield pd.DataFrame(rows, columns=["ref_id", "name"])

    entries = reference.select("ref_id", "field", "canonical").where("ref_id is not null and field is not null and canonical is not null")
    return entries.mapInPandas(names, "ref_id int, name string")
