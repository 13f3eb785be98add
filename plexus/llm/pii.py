"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, plus signs, digits, schemes and
identifier cues in one pass over the whole text. Each anchor is expanded by a
deterministic local parser that settles the boundaries and validates the find:

email    from the at-sign: the local part to the left, labels to the right
ip       from the first digit of a run: four dotted parts of at most 255
card     from the first digit of a run: 13 to 19 digits that pass Luhn
phone    from the plus sign: 9 to 15 digits
account  from a cue (IBAN, account no, ...) or letters before check digits: a
         valid IBAN (mod 97), or after a cue a code of 6 to 30 signs with six digits
address  from a street cue next to a capitalised name and a house number
login    from a scheme: user and password before the host
secret   from a cue (password, token, api key, ...) with "=" or ":" behind it: the
         value, quoted or of one word, if it is no plain word; from the fixed
         prefixes of access keys: the key, if it is as long as such keys are; from
         the head of a PEM block of a private key: the block

Matches of one kind don't overlap; each kind is looked for on its own.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plexus.llm.rows import numbered, place
from plexus.plans.scratch import lean, small_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "address", "login", "secret")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
CODE = re.compile(r"(?:[ \t]*(?:no|nr|number|num|nummer|id)\b\.?)?[ \t]*[:#=]?[ \t]*([A-Z]{0,4}[0-9](?:[ -]?[A-Z0-9]){4,28}[0-9])(?![A-Za-z0-9])", re.I)
LOGIN = re.compile(r"[A-Za-z0-9._%+-]+:[^\s/@:]+@(?=[A-Za-z0-9-])")
NAME = re.compile(r"[\w'-]+")
HOUSE = re.compile(r"[0-9]{1,5}[a-zA-Z]?")
NUMBER_AFTER = re.compile(r"(?: (?:de |du |des |la |del )?[A-ZÀ-Þ][\w'-]*){1,4},? [0-9]{1,5}[a-zA-Z]?(?![\w.])")
PLAIN_AFTER = re.compile(r"\.? [0-9]{1,5}[a-zA-Z]?(?![\w.])")

# Cues that a number follows, and words of street names.
CUES = ("iban", "account", "acct", "konto", "kontonummer", "compte", "cuenta", "passport", "ssn")
STREETS_AFTER_NAME = ("Street", "Avenue", "Road", "Lane", "Boulevard", "Drive")
STREETS_BEFORE_NAME = ("Rue", "rue", "Calle", "calle", "Avenida", "avenida")
STREETS_IN_NAME = ("straße", "strasse", "weg", "gasse")
SECRETS = ("password", "passwort", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "api key", "access_key", "access key", "private_key", "credential", "bearer", "authorization")
# Prefixes of access keys, and what follows them.
KEYS = {
    "AKIA": r"[0-9A-Z]{16}",
    "ASIA": r"[0-9A-Z]{16}",
    "AIza": r"[0-9A-Za-z_-]{35}",
    "ghp_": r"[0-9A-Za-z]{36}",
    "gho_": r"[0-9A-Za-z]{36}",
    "ghs_": r"[0-9A-Za-z]{36}",
    "glpat-": r"[0-9A-Za-z_-]{20}",
    "xoxb-": r"[0-9A-Za-z-]{20,}",
    "xoxp-": r"[0-9A-Za-z-]{20,}",
    "sk-": r"[0-9A-Za-z_-]{20,}",
    "sk_live_": r"[0-9A-Za-z]{24,}",
    "eyJ": r"[0-9A-Za-z_-]{10,}\.eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}",
}
KEY_BODY = {p: re.compile(b + r"(?![0-9A-Za-z])") for p, b in KEYS.items()}
PEM = "-----BEGIN "
PEM_HEAD = re.compile(r"(?:[A-Z]+ )*PRIVATE KEY-----")
PEM_END = re.compile(r"-----END (?:[A-Z]+ )*PRIVATE KEY-----")
VALUE = re.compile(r"""[ \t]*["']?[ \t]*(?:[=:]|=>|:=|\b[Ii]s\b)[ \t]*(?:[Bb]earer |[Bb]asic )?(?:"([^"\s]{6,})"|'([^'\s]{6,})'|([^\s"',;<>]{6,}))""")
AFTER_BEARER = re.compile(r"[ \t]+([^\s\"',;<>]{16,})")


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    put: dict[str, tuple[str, int]] = {"@": ("at", 1), "+": ("plus", 1), "://": ("scheme", 3)}
    put |= {d: ("digit", 1) for d in "0123456789"}
    for c in CUES:
        put |= {x: ("cue", len(c)) for x in (c, c.upper(), c.capitalize())}
    put |= {w: ("after", len(w)) for w in STREETS_AFTER_NAME}
    put |= {w: ("before", len(w)) for w in STREETS_BEFORE_NAME}
    put |= {w: ("within", len(w)) for w in STREETS_IN_NAME}
    for c in SECRETS:
        put |= {x: ("secret", len(c)) for x in (c, c.upper(), c.capitalize(), c.title())}
    put |= {p: ("key", len(p)) for p in KEYS} | {PEM: ("pem", len(PEM))}
    for k, v in put.items():
        a.add_word(k, v)
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def is_secret(value: str) -> bool:
    """No plain word: it has a digit, a sign that words lack, or a capital letter behind a small one."""
    return any(c.isdigit() or not c.isalnum() and c not in ".:!?-_()" for c in value) or any(a.islower() and b.isupper() for a, b in zip(value, value[1:], strict=False))


def name_before(text: str, end: int, least: int) -> int:
    """Where the capitalised name that ends at ``end`` begins, or -1. Names are as long as they are."""
    start = end
    while start > least and NAME.match(text[start - 1]):
        start -= 1
    return start if start < end and text[start].isupper() else -1


def house_before(text: str, end: int, least: int) -> int:
    """Where a house number and one to four capitalised names before ``end`` begin, or -1."""
    at = end - 1 if end > least and text[end - 1] == " " else end
    for names in range(5):
        start = at
        while start > least and NAME.match(text[start - 1]):
            start -= 1
        if names and (m := HOUSE.fullmatch(text, start, at)):
            return m.start() if not (start and text[start - 1] in ".") else -1
        if start == at or not text[start].isupper() or start - 1 < least or text[start - 1] != " ":
            return -1
        at = start - 1
        if at > least and text[at - 1] == ",":
            at -= 1
    return -1


def find(text: str | None, anchors) -> dict[str, list[tuple[int, int]]]:
    """Spans (code points, end exclusive) by kind. Null and empty texts have none."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return found
    reach = dict.fromkeys(KINDS, 0)  # where the last match of a kind ended, failed ones included
    digit = -2
    n = len(text)
    named, closed = 0, True  # where the identifier of the last cue ends; whether an end of a PEM block may still come

    def take(kind: str, start: int, end: int, ok: bool = True) -> None:
        reach[kind] = end
        if ok:
            found[kind].append((start, end))

    for at, (what, size) in anchors.iter(text):
        start = at - size + 1
        if what == "digit":
            first, digit = digit != at - 1, at
            # Within a run of digits only the first can begin a match, unless one has ended inside the run.
            if first or reach["ip"] == at:
                if at >= reach["ip"] and (m := IP.match(text, at)):
                    take("ip", at, m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")))
            if (first or reach["card"] == at) and at >= reach["card"] and (m := CARD.match(text, at)):
                d = digits_of(m[0])
                take("card", at, m.end(), 13 <= len(d) <= 19 and luhn(d))
            if first and at >= 2 + reach["account"] and text[at - 2 : at].isascii() and text[at - 2 : at].isalpha() and text[at - 2 : at].isupper() and not (at > 2 and text[at - 3].isalnum()) and (m := IBAN.match(text, at - 2)):
                code = m[0]
                while len(code) >= 15 and not (mod97(code) and (at - 2 + len(code) == n or not text[at - 2 + len(code)].isalnum())):
                    code = code[:-1].rstrip()
                if len(code) >= 15:
                    take("account", at - 2, at - 2 + len(code))
        elif what == "at":
            left = at
            while left > reach["email"] and text[left - 1] in LOCAL:
                left -= 1
            if left < at and (m := DOMAIN.match(text, at + 1)):
                take("email", left, m.end())
        elif what == "plus":
            if at >= reach["phone"] and (m := PHONE.match(text, at)):
                take("phone", at, m.end(), 9 <= len(digits_of(m[0])) <= 15)
        elif what == "scheme":
            if at + 1 >= reach["login"] and (m := LOGIN.match(text, at + 1)):
                take("login", at + 1, m.end() - 1)
        elif what == "key":
            if start >= reach["secret"] and not (start and (text[start - 1].isalnum() or text[start - 1] in "_-")) and (m := KEY_BODY[text[start : at + 1]].match(text, at + 1)):
                take("secret", start, m.end())
        elif what == "pem":
            if start >= reach["secret"] and (m := PEM_HEAD.match(text, at + 1)):
                end = PEM_END.search(text, m.end()) if closed else None
                closed = end is not None
                take("secret", start, end.end() if end else m.end())
        elif what == "secret":
            # The cue may be part of a longer identifier such as db_password or AUTH_TOKEN_2.
            if start and text[start - 1].isalnum():
                continue
            behind = max(at + 1, named)
            while behind < n and (text[behind].isalnum() or text[behind] == "_"):
                behind += 1
            named = behind
            m = VALUE.match(text, behind) if behind == at + 1 or text[at + 1] in "_sS0123456789" else None
            if m is None and text[start : at + 1].lower() in ("bearer", "token"):
                m = AFTER_BEARER.match(text, at + 1)
            if m and m.start(m.lastindex) >= reach["secret"]:
                value = m[m.lastindex].rstrip(".,;:!?)")
                if len(value) >= 6 and is_secret(value):
                    take("secret", m.start(m.lastindex), m.start(m.lastindex) + len(value))
        elif start and text[start - 1].isalnum() and what != "within" or at + 1 < n and text[at + 1].isalnum():
            continue  # a cue inside a word
        elif what == "cue":
            if (m := CODE.match(text, at + 1)) and m.start(1) >= reach["account"] and len(digits_of(m[1])) >= 6:
                take("account", m.start(1), m.end(1))
        elif what == "after":
            if (first := house_before(text, start, reach["address"])) >= 0:
                take("address", first, at + 1)
        elif what == "before":
            if start >= reach["address"] and (m := NUMBER_AFTER.match(text, at + 1)):
                take("address", start, m.end())
        elif what == "within":
            if (m := PLAIN_AFTER.match(text, at + 1)) and (first := name_before(text, start, reach["address"])) >= 0:
                take("address", first, m.end())
    return found


def listed(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def detect(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Find personal data in every whole text: one row per row of ``docs``, no shuffle.

    Returns the columns of ``keep``, a count n_<kind> for each kind of KINDS,
    base_sha256 (over the four base kinds) and spans (all kinds), both of
    kind:start:end by kind, then start, joined by commas, n_spans, and
    has_personal_data (any span). Null texts are as empty: no spans,
    base_sha256 of the empty string. Repeated rows give repeated results; other
    columns may have any names; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    rows = numbered(docs).select(*(F.col(f"c{place(docs, c)}").alias(f"k{i}") for i, c in enumerate(keep)), F.col(f"c{place(docs, text)}").alias("t"))
    fields = rows.schema.fields[:-1]
    new = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_spans", T.LongType()), T.StructField("has_personal_data", T.BooleanType())]
    names = [f.name for f in [*fields, *new]]

    def over(batches):
        anchors = automaton()
        for batch in batches:
            rows = [find(t, anchors) for t in batch.column(len(fields)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(len(fields))),
                    *(pa.array([len(r[k]) for r in rows], type=pa.int64()) for k in KINDS),
                    pa.array([hashlib.sha256(listed(r, BASE).encode()).hexdigest() for r in rows], type=pa.string()),
                    pa.array([listed(r, KINDS) for r in rows], type=pa.string()),
                    pa.array([sum(map(len, r.values())) for r in rows], type=pa.int64()),
                    pa.array([any(r.values()) for r in rows], type=pa.bool_()),
                ],
                names=names,
            )

    return rows.mapInArrow(lambda b: lean(over(b)), T.StructType([*fields, *new])).toDF(*keep, *(f.name for f in new))
