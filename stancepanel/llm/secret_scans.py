"""Secret scans: pattern matches, and encoded candidates confirmed by their structure.

Base kinds are found by pattern alone. The other kinds are decoded (base64, URL-safe base64, hex) and reported only if
what comes out is well formed: nested DER lengths that fill their parents exactly, the length-prefixed fields of SSH
keys, or the JSON header of a signed token.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancepanel.llm.common import arrow_map, id_and_text

# The base patterns and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "token", "der", "ssh")

SIGNED = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
ARMOURED = re.compile(r"""-----BEGIN ([A-Z0-9 ]+)-----([A-Za-z0-9+/=\s\\"'>|#*,]+)-----END \1-----""")
# What stands between base64 in quoted or escaped text: escaped line ends and tabs, joined literals, indent, quote signs.
WRAPPING = re.compile(r"""\\+[nrt]|["']\s*\+\s*["']|\\+(?=/)|[\s\\"'>|#*,]""")
LINE_END = re.compile(r"""(?:\\*["'][ \t]*[+,]?)?[ \t]*(?:\r?\n|\\+[nr])(?:\\+[nrt]|[\s"'>|#*])*(?:\\+["'])?""")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
# DER starts with 0x30; SSH fields start with a length below 256, and their file form with its name.
BASE64_RUN = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nrt]))[MAb][A-Za-z0-9+/_-]{23,}={0,2}")
HEX_RUN = re.compile(r"(?<![0-9A-Za-z])(?:30|00|6[fF])(?:[0-9a-fA-F]{2}){15,}(?![0-9A-Za-z])")


def decoded(text: str) -> bytes | None:
    """Bytes of a base64 text of either alphabet, padded or not."""
    raw = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(raw) % 4 == 1:
        return None
    try:
        return base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_fields(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """Tag, first and last+1 byte of the fields between two places, if they fill the space exactly."""
    out, at = [], start
    while at < end:
        if at + 2 > end:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 0 < n <= 4 or at + n > end or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at:at + n], "big"), at + n
            if size < 0x80:
                return None
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def is_der_key(data: bytes) -> bool:
    """One sequence that fills the bytes, whose first field is a version or an algorithm and whose nesting holds."""
    if len(data) < 16 or data[0] != 0x30:
        return False
    outer = der_fields(data, 0, len(data))
    if not outer or len(outer) != 1:
        return False
    inner = der_fields(data, outer[0][1], outer[0][2])
    if not inner or len(inner) < 2 or inner[0][0] not in (0x02, 0x30):
        return False
    if inner[0][0] == 0x02 and not (inner[0][2] - inner[0][1] == 1 and data[inner[0][1]] <= 3 or len(inner) == 2):
        return False
    open_ = [f for f in inner if f[0] & 0x20]
    while open_:
        tag, a, b = open_.pop()
        fields = der_fields(data, a, b)
        if fields is None:
            return False
        open_ += [f for f in fields if f[0] & 0x20]
    return any(f[0] in (0x02, 0x03, 0x04, 0x30) for f in inner[1:])


def is_ssh_key(data: bytes) -> bool:
    """The file form of private keys, or a public key: fields with 4-byte lengths that end with the bytes."""
    if data.startswith(b"openssh-key-v1\0"):
        data = data[15:]
    elif data[4:8] not in (b"ssh-", b"ecds"):
        return False
    at, fields = 0, 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + size > len(data):
            return False
        at, fields = at + 4 + size, fields + 1
        if fields == 3 and at + 4 <= len(data) and int.from_bytes(data[at:at + 4], "big") == 1:
            at += 4  # the number of keys of the file form
    return at == len(data) and fields >= 2


def is_token_header(part: str) -> bool:
    raw = decoded(part)
    if not raw or raw[:1] != b"{":
        return False
    try:
        header = json.loads(raw)
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def key_kind(data: bytes | None) -> str | None:
    return data and ("der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None)


def der_length(head: bytes) -> int | None:
    """Number of bytes of a DER sequence by its first bytes."""
    if head[0] != 0x30:
        return None
    if head[1] < 0x80:
        return 2 + head[1]
    n = head[1] & 0x7F
    return 2 + n + int.from_bytes(head[2:2 + n], "big") if 0 < n <= 4 else None


def wrapped_key(text: str, start: int, first: str) -> tuple[str, int] | None:
    """Kind and end of a key whose base64 starts with the line `first` and goes on in lines of the same width.

    Only the last line may be shorter. A DER key ends where its length says; an SSH key with the last line, or with the
    last full one if what follows is other text.
    """
    head = decoded(first[:24])
    if head is None:
        return None
    size = der_length(head)
    if size is None and not (head.startswith(b"openssh-key-v1\0") or head[4:8] in (b"ssh-", b"ecds")):
        return None
    need = None if size is None else -(-4 * size // 3)
    lines, ends, chars = [first], [start + len(first)], len(first)
    while "=" not in lines[-1] and len(lines[-1]) == len(first) and (need is None or chars < need):
        gap = LINE_END.match(text, ends[-1])
        line = gap and LINE.match(text, gap.end())
        if not line or line.end() - line.start() > len(first):
            break
        lines.append(line[0])
        ends.append(line.end())
        chars += len(line[0])
    for n in dict.fromkeys((len(lines), len(lines) - 1, 1)):
        if n:
            kind = key_kind(decoded("".join(lines[:n])))
            if kind:
                return kind, ends[n - 1]
    return None


def confirmed(text: str) -> list[tuple[str, int, int]]:
    """Spans of decoded candidates whose structure holds."""
    out, taken = [], []
    for m in SIGNED.finditer(text) if "ey" in text or "ew" in text else ():  # base64 of an open brace
        if is_token_header(m[1]) and decoded(m[2]) is not None and decoded(m[3]) is not None:
            out.append(("token", *m.span()))
    for m in ARMOURED.finditer(text) if "-----BEGIN" in text else ():
        kind = key_kind(decoded(WRAPPING.sub("", m[2])))
        if kind:
            out.append((kind, *m.span()))
            taken.append(m.span())
    for m in BASE64_RUN.finditer(text):
        if any(a <= m.start() < b for a, b in taken):
            continue
        found = wrapped_key(text, m.start(), m[0])
        if found:
            out.append((found[0], m.start(), found[1]))
            taken.append((m.start(), found[1]))
    for m in HEX_RUN.finditer(text):
        if any(a <= m.start() < b for a, b in taken):
            continue
        kind = key_kind(bytes.fromhex(m[0]))
        if kind:
            out.append((kind, *m.span()))
    return out


def base_matches(text: str) -> list[tuple[str, int, int]]:
    low = text.lower()
    out = []
    if any(word in low for word in ("passw", "secret", "token", "api")):  # the pattern needs one of them
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    ordered = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in ordered)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every whole text; places are code points.

    Null and empty texts have no spans. Rows are scanned one by one: repeated rows and null keys stay as they are, an
    empty table gives an empty result, and other columns are not read.
    """
    def step(batch: pa.RecordBatch) -> pa.Table:
        counts, digests, spans = {k: [] for k in KINDS[:3]}, [], []
        for text in batch.column("text").to_pylist():
            base = base_matches(text)
            for kind, held in counts.items():
                held.append(sum(s[0] == kind for s in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(base + confirmed(text)))
        return pa.table({"doc_id": batch.column("doc_id"),
                         **{f"n_{k}": pa.array(held, pa.int64()) for k, held in counts.items()},
                         "base_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.string())})

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, step, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, "
                                 "spans string")


def masked(text: str, mask: str = "[SECRET]") -> str:
    """The text with every run of overlapping spans replaced by the mask."""
    spans = sorted((a, b) for _, a, b in base_matches(text) + confirmed(text))
    if not spans:
        return text
    out, at, end = [], 0, 0
    for a, b in spans:
        if a >= end:
            out += [text[at:a], mask]
        at = end = max(end, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None, mask: str = "[SECRET]") -> DataFrame:
    """All rows and columns, with secrets in the text column masked; `length_col` gets the new number of code points.

    A null text stays null, and so does its length column.
    """
    def step(batch: pa.RecordBatch) -> pa.Table:
        at = batch.schema.get_field_index(text_col)
        old = batch.column(at).to_pylist()
        new = [t if t is None else masked(t, mask) for t in old]
        out = pa.table(batch).set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
        if length_col:
            to = batch.schema.get_field_index(length_col)
            field = batch.schema.field(to)
            sizes = [had if t == was or t is None else len(t)
                     for t, was, had in zip(new, old, batch.column(to).to_pylist())]
            out = out.set_column(to, field, pa.array(sizes, field.type))
        return out

    return docs.mapInArrow(lambda batches: (b for batch in batches for b in step(batch).to_batches()), docs.schema)
