"""Personal data found by anchors and grown by local parsers.

One Aho-Corasick pass over a text finds at-signs, address schemes, identifier cues and digits. Only there the
parsers look: an at-sign grows into a mailbox, runs of digits into dotted addresses, card numbers and phone
numbers, a scheme into a web address, a cue into the account number or secret that follows it. Each parser is
deterministic and reads what it covers once, so a text costs one pass plus its finds.

The base kinds email, ip, card and phone follow the fixed forms below, leftmost and non-overlapping per kind:
    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)       parts of at most 255
    card   [0-9]([\\x20-]?[0-9])+                      16 to 19 digits that pass the Luhn test
    phone  \\+[0-9][\\x20().0-9-]+[0-9]                 8 to 15 digits
A match that fails its test is dropped and not tried again. The method adds web addresses (url), secrets after
cues such as `password` (secret) and account numbers after cues such as `IBAN` (account). Words such as `number`,
`no.` and `is` may stand between. An account number may be written in groups over single spaces or hyphens: an IBAN
that passes its check ends where its country's length says, other numbers where the groups of digits end. A value in
one piece with an IBAN's form and length whose check fails is no account.

Defined cases: null and empty texts hold nothing; repeated rows are reported alike; positions count code points;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import small_batches, text_or_empty, texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "secret", "account")
SECRET_CUES = ("password", "passwd", "token", "secret", "api_key", "api-key", "apikey", "access_key", "access-key")
#: Spellings besides lower, title and upper case.
MIXED_CUES = ("ApiKey", "apiKey", "AccessKey", "accessKey", "Api-key", "Api_key", "Access-key", "Access_key")
ACCOUNT_CUES = ("iban", "account", "acct", "ssn", "passport", "routing")
#: Length of an IBAN by country.
IBAN = dict(
    part.split(":")
    for part in (
        "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 "
        "ES:24 FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 "
        "LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 "
        "QA:29 RO:24 RS:22 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20"
    ).split()
)
#: Digits of a first group, and of all groups, of a number written in groups.
MOST_GROUP = 6
MOST_DIGITS = 20
LEAST_VALUE = 6
MOST_GAP = 4

DIGITS = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
SCHEME = ALNUM | frozenset("+.-")
VALUE = ALNUM | frozenset("_+/-")
CARD_GAP = frozenset(" -")
PHONE_GAP = frozenset(" ().-")
VALUE_GAP = frozenset(" \t:=#\"'")
ADDRESS_END = frozenset(" \t\r\n\x0b\x0c\"'<>`{}|\\^")
ADDRESS_TRIM = frozenset(".,;:!?)]")

SCHEMA = ", ".join(["doc_id long", *(f"n_{k} long" for k in BASE), "base_sha256 string", "spans string"])

_between = re.compile(r"""[ \t:=#"']{1,4}(?:numbers?|num|no|nr|is|was)\b\.?""", re.IGNORECASE)

_automata: list = []


def automaton():
    """At-signs, schemes, cues (in three spellings) and digits; made once in each worker."""
    if not _automata:
        import ahocorasick

        made = ahocorasick.Automaton()
        for digit in DIGITS:
            made.add_word(digit, ("digit", 1))
        made.add_word("@", ("at", 1))
        made.add_word("://", ("scheme", 3))
        for kind, cues in (("secret", SECRET_CUES), ("account", ACCOUNT_CUES)):
            for cue in cues:
                for spelt in {cue, cue.title(), cue.upper()}:
                    made.add_word(spelt, (kind, len(spelt)))
        for spelt in MIXED_CUES:
            made.add_word(spelt, ("secret", len(spelt)))
        made.make_automaton()
        _automata.append(made)
    return _automata[0]


def anchors(text: str):
    """Runs of digits, at-signs, schemes and ends of cues, each in the order of the text."""
    runs: list[tuple[int, int]] = []
    ats, schemes, cues = [], [], []
    for last, (kind, length) in automaton().iter(text):
        if kind == "digit":
            if runs and runs[-1][1] == last:
                runs[-1] = (runs[-1][0], last + 1)
            else:
                runs.append((last, last + 1))
        elif kind == "at":
            ats.append(last)
        elif kind == "scheme":
            schemes.append(last + 1 - length)
        else:
            cues.append((kind, last + 1 - length, last + 1))
    return runs, ats, schemes, cues


def emails(text: str, ats: list[int]):
    free, n = 0, len(text)
    for at in ats:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start == at:
            continue
        end, labels, here = at, 0, at + 1
        while True:
            stop = here
            while stop < n and text[stop] in LABEL:
                stop += 1
            if stop == here:
                break
            labels, end = labels + 1, stop
            if stop >= n or text[stop] != ".":
                break
            here = stop + 1
        if labels >= 2:
            yield start, end
            free = end


def _chains(text: str, runs: list[tuple[int, int]], gaps: frozenset):
    """Groups of runs that follow each other over one character of `gaps`."""
    group: list[tuple[int, int]] = []
    for run in runs:
        if group and run[0] == group[-1][1] + 1 and text[run[0] - 1] in gaps:
            group.append(run)
        else:
            if group:
                yield group
            group = [run]
    if group:
        yield group


def addresses(text: str, runs: list[tuple[int, int]]):
    for group in _chains(text, runs, frozenset(".")):
        for k in range(0, len(group) - 3, 4):
            parts = [text[a:b].lstrip("0") for a, b in group[k : k + 4]]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                yield group[k][0], group[k + 3][1]


def luhn(digits: str) -> bool:
    doubled = sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return (doubled + sum(int(d) for d in digits[::-2])) % 10 == 0


def cards(text: str, runs: list[tuple[int, int]]):
    for group in _chains(text, runs, CARD_GAP):
        if 16 <= sum(b - a for a, b in group) <= 19 and luhn("".join(text[a:b] for a, b in group)):
            yield group[0][0], group[-1][1]


def phones(text: str, runs: list[tuple[int, int]]):
    k = 0
    while k < len(runs):
        start = runs[k][0]
        if not start or text[start - 1] != "+":
            k += 1
            continue
        last, digits = k, runs[k][1] - start
        while last + 1 < len(runs) and all(c in PHONE_GAP for c in text[runs[last][1] : runs[last + 1][0]]):
            last += 1
            digits += runs[last][1] - runs[last][0]
        if runs[last][1] - start >= 3 and 8 <= digits <= 15:
            yield start - 1, runs[last][1]
        k = last + 1


def web_addresses(text: str, schemes: list[int]):
    free, n = 0, len(text)
    for at in schemes:
        start = at
        while start > free and text[start - 1] in SCHEME:
            start -= 1
        while start < at and not text[start].isalpha():
            start += 1
        if start == at or start < free:
            continue
        end = at + 3
        while end < n and text[end] not in ADDRESS_END:
            end += 1
        while end > at + 3 and text[end - 1] in ADDRESS_TRIM:
            end -= 1
        if end > at + 3:
            yield start, end
        free = end


def iban_end(text: str, start: int) -> int:
    """The end of the IBAN that starts here, in groups or not, or 0 where none passes the check."""
    length, held, at = int(IBAN.get(text[start : start + 2].upper(), 0)), [], start
    while len(held) < length and at < len(text):
        if text[at] in ALNUM:
            held.append(text[at].upper())
        elif text[at] not in CARD_GAP or text[at - 1] not in ALNUM:
            return 0
        at += 1
    if not length or len(held) < length or at < len(text) and text[at] in ALNUM:
        return 0
    return at if int("".join(str(int(c, 36)) for c in held[4:] + held[:4])) % 97 == 1 else 0


def iban_shaped(value: str) -> bool:
    """Whether a value has a country's code, two check digits and that country's length, so that the check decides."""
    country, checks = value[:2].upper(), value[2:4]
    return int(IBAN.get(country, 0)) == len(value) and DIGITS.issuperset(checks) and ALNUM.issuperset(value)


def grouped_end(text: str, start: int, end: int) -> int:
    """The end of a number whose first run, up to `end`, may be followed by groups of digits over single spaces."""
    first = re.split("-", text[start:end])
    if not all(DIGITS.issuperset(g) and 0 < len(g) <= MOST_GROUP for g in first):
        return end
    digits, n = sum(map(len, first)), len(text)
    while end + 1 < n and text[end] == " ":
        stop = end + 1
        while stop < n and text[stop] in VALUE:
            stop += 1
        group = text[end + 1 : stop]
        if not (DIGITS.issuperset(group) and 2 <= len(group) <= MOST_GROUP and digits + len(group) <= MOST_DIGITS):
            break
        digits, end = digits + len(group), stop
    return end


def cued_values(text: str, cues: list[tuple[str, int, int]]):
    """(kind, start, end) of values with a digit that stand behind a cue word, or words such as `number is` after it."""
    free, n = 0, len(text)
    for kind, begins, here in cues:
        if begins and text[begins - 1] in ALNUM or here < n and text[here] in ALNUM:
            continue
        while filler := _between.match(text, here):
            here = filler.end()
        start = here
        while start < n and start - here < MOST_GAP and text[start] in VALUE_GAP:
            start += 1
        if start == here and text[start - 1] != "." or start < free:
            continue
        end = start
        while end < n and text[end] in VALUE:
            end += 1
        if kind == "account":
            end = iban_end(text, start) or (start if iban_shaped(text[start:end]) else grouped_end(text, start, end))
        if end - start >= LEAST_VALUE and not DIGITS.isdisjoint(text[start:end]):
            yield kind, start, end
        free = end


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all finds, in the order of KINDS and then of the text."""
    runs, ats, schemes, cues = anchors(text)
    out = [("email", a, b) for a, b in emails(text, ats)]
    if runs:
        out += [("ip", a, b) for a, b in addresses(text, runs)]
        out += [("card", a, b) for a, b in cards(text, runs)]
        out += [("phone", a, b) for a, b in phones(text, runs)]
    out += [("url", a, b) for a, b in web_addresses(text, schemes)]
    values = list(cued_values(text, cues))
    return out + [v for v in values if v[0] == "secret"] + [v for v in values if v[0] == "account"]


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans of every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for text in texts(batch):
                spans = find(text)
                counts = Counter(k for k, _, _ in spans)
                base = _joined(s for s in spans if s[0] in BASE)
                rows.append((*(counts[k] for k in BASE), hashlib.sha256(base.encode()).hexdigest(), _joined(spans)))
            frame = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in BASE), "base_sha256", "spans"])
            frame.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield frame.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInPandas(run, SCHEMA)
