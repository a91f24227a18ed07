"""Personal data: base patterns, and a conditional random field over word shapes that finds other ways of writing.

The base kinds are found by pattern and checked. The field is trained on a small labelled table: lines written for it
(`LINES`, with marked spans) and words around base matches of a bounded sample of the documents. It labels the words of
every line; labelled stretches that do not touch a base span are reported if they hold up as the kind they are
(`confirmed`): an address with a domain, four numbers up to 255, a valid card sum, enough digits.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancepanel.llm.common import arrow_map, id_and_text, slices
from stancepanel.llm.shape_crf import ShapeChain, Words, luhn

# Kinds in their order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:(\.[0-9]++)(\.[0-9]++)(\.[0-9]++))?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Lines of the labelled table; <kind|...> is a span of that kind. Other lines hold none.
LINES = """
write to <email|anna.berg at mail dot org> before friday
contact <email|j.ortiz (at) example (dot) com> for the form
e-mail: <email|info [at] station [dot] net> or call
mail <email|paul_b@example.com> today
ask <email|maria at webpost dot es> about it
reply to <email|k.lind{at}example{dot}org>, please
send it to <email|tom AT office DOT example DOT com> now
my address is <email|rita [at] box.example.com>.
<email|sales(at)shop.example.net> answers within a day
my mail is <email|eva dot stone at example dot com> for now
try <email|karl [at] nord [dot] de> first
call <phone|(212) 555-0147> after nine
dial <phone|1-800-555-0199> to order
tel: <phone|0171 555 8890> is mine
phone: <phone|212-555-0199> or write
tel <phone|030 5550 1234> in the morning
tel. <phone|0049 30 5550123> for orders
mobile <phone|07700 900 123> anytime
fax <phone|555-0133-22> only
ring <phone|(0)20 7946 0958> and ask for eva
phone <phone|+44 20 7946 0958> or <phone|020 7946 0123>
number <phone|212.555.0164> on the card
you can reach me at <phone|415 555 0170> tonight
whatsapp <phone|+1-202-555-0143>
the host <ip|10[.]20[.]30[.]40> was seen
blocked <ip|192(.)168(.)1(.)77> last night
from <ip|172 . 16 . 4 . 9> to the gateway
server <ip|2001:db8:0:0:8:800:200c:417a> answered
ping <ip|fe80::1ff:fe23:4567:890a> failed
route <ip|2001:db8::ff00:42:8329> is up
address <ip|93.184.216.34> port 80
logged in from <ip|203[.]0[.]113[.]9>
<ip|198 dot 51 dot 100 dot 23> tried again
card <card|4111.1111.1111.1111> was charged
visa <card|4111/1111/1111/1111> expires soon
pay with <card|5500 0000 0000 0004> or cash
number <card|4012_8888_8888_1881> on file
amex <card|3782.822463.10005> declined
master <card|5555.5555.5555.4444> accepted
version 1.2.3 was out on 2024-05-06 at 10:30:00
see section 4.2.1.7.3 of the manual for details
the price rose from 1,299.00 to 1,450.50 in 2019
order no. 12345678 of lot 4711-22 has shipped
isbn 978-3-16-148410-0 is out of print
we met at noon and the dot on the map was red
look at the point (3) and at line 12 of page 400
key a4a14da4dc9b206c0209041b0961df015c66b4f9 is revoked
between 1914 and 1918, about 20,000,000 people
room 305, floor 3, building 12, 90210 springfield
ratio 3.14159 of 2.71828 at 0.577 percent
scores 3-1, 2-2 and 0-4 in the group of 2012
at example dot in the corner of a large sheet
the set {1, 2, 3, 5, 8, 13, 21} has seven members
serial 1234 5678 9012 3456 78 is not valid
call it a day at 5 and dot the i
id 4111111111111112 failed the check twice
tracking 9400 1000 0000 0000 0000 00 arrived
at 17:45 the train to platform 9 left
lat 52.5200 lon 13.4050 in the table
on 12.05.2011 and 3.11.2014 nothing happened
he ran 10 km in 42:10 and 5 km in 19:55
""".strip().splitlines()

ENDINGS = ("com", "org", "net", "de", "es", "fr", "io", "edu", "info")

#: Documents of the sample, windows of it that are learned from, words on either side of a base span, longest window.
SAMPLED, WINDOWS, AROUND, LONGEST = 2_000, 800, 8, 400
TRIM_LEFT, TRIM_RIGHT = re.compile(r"[^A-Za-z0-9+(]*"), re.compile(r"[^A-Za-z0-9]*$")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of the base matches, by kind, then place; code points, end exclusive."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        at = 0
        while run := LOCAL.search(text, at):  # a match holds all of a run up to the at sign
            at = run.end()
            if text.startswith("@", at) and (domain := DOMAIN.match(text, at + 1)):
                at = domain.end()
                out.append(("email", run.start(), at))
    for m in DOTTED.finditer(text):
        if m[1] and all(_byte(p) for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def _byte(number: str) -> bool:
    """Whether a run of digits is at most 255, leading zeros included."""
    return len(number.lstrip("0")) <= 3 and int(number.lstrip("0") or 0) <= 255


def joined(spans: list[tuple[str, int, int]]) -> str:
    ordered = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in ordered)


def confirmed(kind: str, span: str) -> bool:
    """Whether a stretch that the field labels is written as its kind must be."""
    if kind == "email":
        plain = re.sub(r"\s*(?:[\[({<]\s*at\s*[\])}>]|\s+at\s+|@)\s*", "@", span, count=1, flags=re.I)
        plain = re.sub(r"\s*[\[({<]\s*dot\s*[\])}>]\s*|\s+dot\s+", ".", plain, flags=re.I)
        local, _, domain = plain.partition("@")
        spelt = re.search(r"\sat\s", span, re.I) and domain.lower().endswith(".at")  # "the dot at" is prose
        return bool(not spelt and LOCAL.fullmatch(local) and DOMAIN.fullmatch(domain) and domain[-1].isalpha())
    if kind == "ip":
        plain = re.sub(r"\s*(?:\[\.\]|\(\.\)|\bdot\b|\.)\s*", ".", span, flags=re.I)
        try:
            ipaddress.ip_address(plain)
        except ValueError:
            return False
        return True
    digits = "".join(c for c in span if "0" <= c <= "9")
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9 ./_-]+", span) is not None
    return 7 <= len(digits) <= 15 and re.fullmatch(r"[+(]?[0-9][0-9 ().\-/]*", span) is not None


def marked(line: str) -> tuple[str, list[tuple[str, int, int]]]:
    """A line of the labelled table as plain text and spans."""
    text, spans = "", []
    for part in re.split(r"(<(?:email|ip|card|phone)\|.*?>)(?=[\s.,]|$)", line):
        if m := re.fullmatch(r"<(\w+)\|(.*)>", part):
            spans.append((m[1], len(text), len(text) + len(m[2])))
            part = m[2]
        text += part
    return text, spans


def labels_of(words: Words, spans: list[list[tuple[str, int, int]]]) -> np.ndarray:
    """One label per word: 0 outside, 1 + 2k the first and 2 + 2k a further word of kind k. `spans` by text."""
    out = np.zeros(len(words.start), np.int64)
    bounds = np.searchsorted(words.text, np.arange(len(spans) + 1))
    for number, held in enumerate(spans):
        lo, hi = bounds[number:number + 2]
        for kind, a, b in held:
            rows = lo + np.flatnonzero((words.end[lo:hi] > a) & (words.start[lo:hi] < b))
            out[rows] = 2 + 2 * KINDS.index(kind)
            out[rows[:1]] -= 1
    return out


def trained(lines: list[tuple[str, list[tuple[str, int, int]]]]) -> ShapeChain:
    """The field of a labelled table of lines with their spans."""
    words = Words([text.replace("\n", " ") for text, _ in lines])
    return ShapeChain(1 + 2 * len(KINDS)).fit(words, labels_of(words, [s for _, s in lines]))


def sample_windows(docs: DataFrame) -> list[str]:
    """Windows of words around base spans, and one more of each document, from a hashed sample of about SAMPLED
    documents: at most WINDOWS of at most LONGEST code points reach the driver."""
    rows = max(1, docs.count())
    share = min(1 << 30, math.ceil(SAMPLED / rows * (1 << 30)))
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share)

    def step(batch: pa.RecordBatch) -> pa.Table:
        out, held = [], []
        for text in batch.column("text").to_pylist():
            places = [(a, b, 1) for _, a, b in base_spans(text)]
            third = len(text) // 3
            for a, b, has in [*places, (third, third, 0)]:
                left = text[max(0, a - LONGEST):a].split(" ")[-AROUND:]
                right = text[b:b + LONGEST].split(" ")[:AROUND]
                window = (" ".join(left) + text[a:b] + " ".join(right)).replace("\n", " ").strip()
                if 0 < len(window) <= LONGEST:
                    out.append(window)
                    held.append(has)
        return pa.table({"window": pa.array(out, pa.string()), "has": pa.array(held, pa.int64())})

    windows = arrow_map(sample.select("text"), step, "window string, has long").distinct()
    half = WINDOWS // 2
    return sorted(r.window for has in (0, 1) for r in windows.where(F.col("has") == has).orderBy(
        F.xxhash64("window"), "window").limit(half).collect())


def model(docs: DataFrame, text_col: str = "text") -> ShapeChain:
    """The field learned from LINES and from a sample of the documents, whose base spans are its labels."""
    found = sample_windows(docs.select(F.coalesce(docs[text_col], F.lit("")).alias("text")))
    return trained(labelled_table(found))


def varied(kind: str, span: str, words: list[str], rng: np.random.Generator) -> str:
    """A span written the same way with other digits, numbers or names; card sums stay valid."""
    if kind == "email":
        return re.sub(r"[A-Za-z]{2,}", lambda m: m[0] if m[0].lower() in ("at", "dot") else
                      ENDINGS[rng.integers(len(ENDINGS))] if m[0].lower() in ENDINGS else
                      words[rng.integers(len(words))], span)
    if kind == "ip" and ":" in span:
        return re.sub(r"[0-9a-f]+", lambda m: f"{rng.integers(1 << 16):x}", span)
    if kind == "ip":
        return re.sub(r"[0-9]+", lambda m: str(rng.integers(256)), span)
    new = re.sub(r"[0-9]", lambda m: str(rng.integers(10)), span)
    if kind == "card":
        new = next(n for d in range(10) if luhn(re.sub(r"[^0-9]", "", n := new[:-1] + str(d))))
    return new


def labelled_table(windows: list[str], copies: int = 12) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """LINES, the windows with their base spans, and windows with a variant of a marked span of LINES set into them."""
    own, rng = [marked(line) for line in LINES], np.random.default_rng(7)
    learned = [(w, base_spans(w)) for w in windows]
    plain = [w.split(" ") for w, spans in learned if not spans]
    names = [w for words in plain for w in words if w.isascii() and w.isalpha() and len(w) > 2] or ["someone"]
    for text, kind, a, b in [(t, *s) for t, spans in own for s in spans] * copies:
        words = plain[rng.integers(len(plain))] if plain else []
        half = int(rng.integers(len(words) + 1))
        left, new = " ".join([*words[:half], ""]), varied(kind, text[a:b], names, rng)
        end = ("", ".", ",")[rng.integers(3)]
        learned.append((" ".join([left + new + end, *words[half:]]), [(kind, len(left), len(left) + len(new))]))
    return own * 2 + learned


def further_spans(chain: ShapeChain, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list]:
    """Spans that the field adds to the base spans of each text."""
    words = Words(texts)
    label = chain.decode(words)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    rows = np.flatnonzero(label)
    if not len(rows):
        return out
    kind = (label[rows] - 1) // 2
    line = np.searchsorted(words.first, rows, side="right")
    opens = np.r_[True, (rows[1:] != rows[:-1] + 1) | (label[rows[1:]] % 2 == 1) | (kind[1:] != kind[:-1])
                  | (line[1:] != line[:-1])]
    edge = np.flatnonzero(np.r_[opens, True])
    for i, j in zip(edge[:-1], edge[1:]):
        first, last, number = rows[i], rows[j - 1], words.text[rows[i]]
        text = texts[number]
        a, b = int(words.start[first]), int(words.end[last])
        a += TRIM_LEFT.match(text[a:b]).end()
        b -= len(TRIM_RIGHT.search(text[a:b])[0])
        name = KINDS[kind[i]]
        if a < b and not any(a < e and s < b for _, s, e in base[number]) and confirmed(name, text[a:b]):
            out[number].append((name, a, b))
    return out


def all_spans(chain: ShapeChain, texts: list[str]) -> Iterator[tuple[list, list]]:
    """Base spans and added spans of each text."""
    for part in slices(texts, 1_500_000):
        base = [base_spans(t) for t in part]
        yield from zip(base, further_spans(chain, part, base))


def scan(docs: DataFrame, chain: ShapeChain | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every whole text; places are code points.

    Without a `chain` the field is learned first (`model`). Null and empty texts have no spans. Rows are scanned one by
    one: repeated rows and null keys stay as they are, an empty table gives an empty result, other columns are not read.
    Texts of any length are scanned whole, line by line.
    """
    rows = id_and_text(docs, id_col, text_col)
    shared = rows.sparkSession.sparkContext.broadcast(model(rows) if chain is None else chain)  # a table of weights

    def step(batch: pa.RecordBatch) -> pa.Table:
        counts, digests, spans = {k: [] for k in KINDS}, [], []
        for base, more in all_spans(shared.value, batch.column("text").to_pylist()):
            for kind, held in counts.items():
                held.append(sum(s[0] == kind for s in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(base + more))
        return pa.table({"doc_id": batch.column("doc_id"),
                         **{f"n_{k}": pa.array(held, pa.int64()) for k, held in counts.items()},
                         "base_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.string())})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, step, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS)
                     + ", base_sha256 string, spans string")
