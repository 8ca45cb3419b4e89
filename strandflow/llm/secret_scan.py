"""Secret scan with structural confirmation.

Three base patterns give candidate spans; on top of them, encoded material is
reported only once its structure parses:

* PEM blocks and bare base64 (also url-safe, wrapped at line ends, or glued to
  other characters) or hex runs must decode to a private key. Its DER records
  must fill their parents exactly and have the fields of PKCS#1, PKCS#8 (also
  encrypted), SEC1 or DSA keys; an OpenSSH key has its magic and lengths; a PEM
  block may be encrypted under RFC 1421 headers, or hold an OpenPGP secret-key packet.
  Public keys, certificates and signatures are none.
* signed tokens must carry a JSON header that names an algorithm and a JSON body.

``find_spans`` is the whole rule for one text; runs and markers are each found in
one pass over it. The operator first looks at all bytes of a batch with vectorised
necessary conditions (a keyword, ``AKIA``, a long run of hex or base64 characters,
``eyJ``, ``-----BEGIN``) and calls it for the documents that meet one of them, so
nothing is skipped or shortened.

Null and empty texts have no spans. Repeated rows give repeated results, whatever
their ids; an empty table gives none.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm import textkernels as K

KINDS = ("assign", "access", "hex", "token", "pem", "der", "derhex")
ASSIGN = re.compile(
    "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_RUN = re.compile(r"[0-9a-f]{32,}")
TOKEN_RUN = re.compile(r"[A-Za-z0-9_.-]+")
PEM_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]+)-----")
PEM_HEADER = re.compile(r"[A-Za-z-]+: ?(.*)")
#: A long run with the lines that follow it at once.
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}(?:\r?\n[\t ]*[A-Za-z0-9+/_-]+)*")
HEX_LONG = re.compile(r"[0-9A-Fa-f]{64,}")
OPENSSH = b"openssh-key-v1\0"
#: The magic has 15 bytes, so its base64 form ends with it.
OPENSSH_64 = base64.b64encode(OPENSSH).decode()
KEY_START = re.compile("M|" + OPENSSH_64)

KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
LITERALS = (b"AKIA", b"eyJ", b"-----BEGIN ")
_HEX_BYTES = K.byte_table(lambda b: chr(b) in "0123456789abcdefABCDEF")
_BASE64_BYTES = K.byte_table(lambda b: b < 128 and (chr(b).isalnum() or chr(b) in "+/-_"))

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_confirmed long, base_sha256 string, spans string"


def size_of(data: bytes, at: int) -> tuple[int, int] | None:
    """(start of the content, its end) of the DER record at ``at``, whether or not it ends inside the data."""
    if at + 2 > len(data):
        return None
    size, body = data[at + 1], at + 2
    if size & 0x80:
        k = size & 0x7F
        if not 1 <= k <= 4 or body + k > len(data):
            return None
        size, body = int.from_bytes(data[body : body + k], "big"), body + k
        if size < 0x80 or k > 1 and size >> 8 * (k - 1) == 0:  # not the shortest form
            return None
    return body, body + size


def records(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the DER records that fill ``data`` exactly."""
    at, out = 0, []
    while at < len(data):
        found = size_of(data, at)
        if found is None or found[1] > len(data):
            return None
        out.append((data[at], data[found[0] : found[1]]))
        at = found[1]
    return out


INTEGER, OCTETS, OID, SEQUENCE = 2, 4, 6, 0x30


def _algorithm(content: bytes) -> bool:
    """An object identifier, maybe with parameters."""
    inner = records(content)
    return bool(inner) and len(inner) <= 2 and inner[0][0] == OID and len(inner[0][1]) > 0


def is_der_key(data: bytes) -> bool:
    """One SEQUENCE that fills the bytes, with the fields of a private key."""
    outer = records(data)
    if outer is None or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return False
    fields = records(outer[0][1])
    if not fields or len(fields) < 2:
        return False
    tags = [t for t, _ in fields]
    if tags[0] == SEQUENCE:  # encrypted PKCS#8
        return tags == [SEQUENCE, OCTETS] and _algorithm(fields[0][1])
    if tags[0] != INTEGER or len(fields[0][1]) != 1:
        return False
    version = fields[0][1][0]
    if tags[1:3] == [SEQUENCE, OCTETS]:  # PKCS#8
        return version <= 1 and _algorithm(fields[1][1]) and all(t in (0xA0, 0x81, 0xA1) for t in tags[3:])
    if tags[1] == OCTETS:  # SEC1
        return version == 1 and len(fields[1][1]) >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
    if all(t == INTEGER for t in tags):
        if not all(c for _, c in fields):
            return False
        return version == 0 and len(tags) in (6, 9)  # DSA; PKCS#1
    return version == 1 and len(tags) == 10 and tags[1:9] == [INTEGER] * 8 and tags[9] == SEQUENCE  # PKCS#1 of many primes


def openssh_size(data: bytes) -> int:
    """Length of the OpenSSH key that the data begin with, 0 for none: magic, three strings, a number of keys, and as many public parts and one private."""
    if not data.startswith(OPENSSH):
        return 0
    at = len(OPENSSH)

    def skip(at: int) -> int:
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        return end if at + 4 <= len(data) and end <= len(data) else -1

    for _ in range(3):
        if (at := skip(at)) < 0:
            return 0
    n = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= n <= 64:
        return 0
    for _ in range(n + 1):
        if (at := skip(at)) < 0:
            return 0
    return at


def is_key(data: bytes) -> bool:
    return openssh_size(data) > 0 or is_der_key(data)


def _decode64(text: str) -> bytes:
    text = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _pem_holds_key(label: str, body: str) -> bool:
    headers, lines, wrapped = [], [], False
    for line in body.strip().splitlines():
        if not lines and (m := PEM_HEADER.fullmatch(line.strip())):
            headers.append(m[1])
            wrapped = True
        elif wrapped and not lines and line[:1] in " \t" and line.strip():
            headers.append(line.strip())
        elif line.strip():
            lines.append(line)
    if lines and re.fullmatch(r"=[A-Za-z0-9+/]{4}", lines[-1].strip()):
        lines.pop()
    data = _decode64("".join(lines))
    if label.startswith("PGP PRIVATE KEY"):
        return bool(data) and data[0] & 0x80 > 0 and (data[0] & 0x3F if data[0] & 0x40 else data[0] >> 2 & 0xF) == 5
    if any("ENCRYPTED" in h for h in headers):
        return label.endswith("PRIVATE KEY") and len(data) >= 16 and len(data) % 8 == 0
    return is_key(data)


def _pem_spans(text: str) -> Iterator[tuple[str, int, int]]:
    marks = list(PEM_MARK.finditer(text))
    following: dict[str, re.Match] = {}
    found = []
    for m in reversed(marks):
        if m[1] == "END":
            following[m[2]] = m
        elif (end := following.get(m[2])) is not None:
            found.append((m, end))
    done = 0
    for m, end in reversed(found):
        if m.start() >= done and not any(x in text[m.end() : end.start()] for x in ("-----BEGIN",)) and _pem_holds_key(m[2], text[m.end() : end.start()]):
            yield "pem", m.start(), end.end()
            done = end.end()


def _may_be_key(head: bytes) -> int:
    """Length of the record if the first bytes are those of a private key in DER, else 0."""
    if head[:1] != b"\x30" or (found := size_of(head, 0)) is None:
        return 0
    body, end = found
    inner = head[body : body + 3]
    return end if inner[:2] == b"\x02\x01" and inner[2:] in (b"\0", b"\1") or inner[:1] == b"\x30" else 0


def _der_spans(text: str) -> Iterator[tuple[str, int, int]]:
    for m in BASE64_RUN.finditer(text):
        run = m[0]
        place = [i for i, c in enumerate(run) if c > " "] if "\n" in run else range(len(run))
        clean = re.sub(r"\s", "", run).replace("-", "+").replace("_", "/")
        at = 0
        while start := KEY_START.search(clean, at):
            at = start.start()
            if clean.startswith(OPENSSH_64, at):
                size = openssh_size(_decode64(clean[at : len(clean) - ((len(clean) - at) % 4 == 1)]))
            else:
                size = _may_be_key(_decode64(clean[at : at + 16]))
            many = -(-size * 4 // 3)
            if size and at + many <= len(clean) and is_key(_decode64(clean[at : at + many])[:size]):
                end = m.start() + place[at + many - 1] + 1
                while end < len(text) and text[end] == "=":
                    end += 1
                yield "der", m.start() + place[at], end
                at += many
            else:
                at += 1


def _derhex_spans(text: str) -> Iterator[tuple[str, int, int]]:
    for m in HEX_LONG.finditer(text):
        run, at = m[0], 0
        while (at := run.find("30", at)) >= 0:
            many = 2 * _may_be_key(bytes.fromhex(run[at : at + min(18, (len(run) - at) // 2 * 2)]))
            if many and at + many <= len(run) and is_der_key(bytes.fromhex(run[at : at + many])):
                yield "derhex", m.start() + at, m.start() + at + many
                at += many
            else:
                at += 1


_JSON = json.JSONDecoder()


def _is_object(text: str, at: int, needs: str | None = None) -> bool:
    """Does a JSON object (with a string under ``needs``) stand from ``at`` to the end?"""
    try:
        found, end = _JSON.raw_decode(text, at)
    except (ValueError, RecursionError):
        return False
    return end == len(text) and isinstance(found, dict) and (needs is None or isinstance(found.get(needs), str))


def _token_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Header, body and signature between dots; a header may be glued to what stands before it."""
    for m in TOKEN_RUN.finditer(text):
        if "eyJ" not in m[0]:
            continue
        parts, edge = m[0].split("."), m.start()
        for i, part in enumerate(parts[:-2]):
            at = part.find("eyJ")
            if at >= 0 and _is_object(_decode64(parts[i + 1]).decode("latin-1"), 0):
                decoded = [_decode64(part[k:]).decode("latin-1") for k in range(4)]
                while at >= 0 and not _is_object(decoded[at % 4], at // 4 * 3, "alg"):
                    at = part.find("eyJ", at + 1)
                if at >= 0:
                    yield "token", edge + at, edge + sum(map(len, parts[i : i + 3])) + 2
            edge += len(part) + 1


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by kind as listed."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # a run of 32 or more is where a greedy run that is long enough starts and ends
    out += [("hex", m.start(), m.end()) for m in HEX_RUN.finditer(text)]
    for found in (_token_spans, _pem_spans, _der_spans, _derhex_spans):
        out += found(text)
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _occurrences(data: bytes, literal: bytes) -> Iterator[int]:
    at = data.find(literal)
    while at >= 0:
        yield at
        at = data.find(literal, at + 1)


def candidates(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Documents of a piece that can have any span."""
    places = [np.fromiter(_occurrences(low, k), np.int64) for low in (K.LOWER[data].tobytes(),) for k in KEYWORDS]
    places += [np.fromiter(_occurrences(raw, k), np.int64) for raw in (data.tobytes(),) for k in LITERALS]
    for table, least in ((_HEX_BYTES, 32), (_BASE64_BYTES, 40)):
        runs = K.words(data, at, table)
        places.append(runs.starts[runs.ends - runs.starts >= least])
    return np.unique(np.searchsorted(at, np.concatenate(places), "right") - 1)


def _digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_NONE = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")


def _row(text: str) -> tuple:
    spans = find_spans(text)
    base = [s for s in spans if s[0] in KINDS[:3]]
    count = [sum(s[0] == k for s in base) for k in KINDS[:3]]
    return (*count, len(spans) - len(base), hashlib.sha256(_digest(base).encode()).hexdigest(), _digest(spans))


@K.tidy
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_NONE] * batch.num_rows
        for lo, _, data, at in K.pieces(batch.column("text")):
            for d in candidates(data, at).tolist():
                rows[lo + d] = _row(data[at[d] : at[d + 1]].tobytes().decode("utf-8", "replace"))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])],
            ["doc_id", "n_assign", "n_access", "n_hex", "n_confirmed", "base_sha256", "spans"],
        )


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with counts by base kind, a digest of base spans, and all spans."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_scan, SCHEMA)


def without_spans(text: str, mark: str) -> str:
    out, at = [], 0
    for _, start, end in find_spans(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _redactor(mark: str):
    @K.tidy
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new: dict[int, str] = {}
            for lo, _, data, at in K.pieces(batch.column("text")):
                for d in candidates(data, at).tolist():
                    text = data[at[d] : at[d + 1]].tobytes().decode("utf-8", "replace")
                    if (kept := without_spans(text, mark)) != text:
                        new[lo + d] = kept
            if new:
                texts = batch.column("text").to_pylist()
                for row, text in new.items():
                    texts[row] = text
                names = batch.schema.names
                batch = pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(i).type) if n == "text" else batch.column(i) for i, n in enumerate(names)], names)
            yield batch

    return clean


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with each run of overlapping spans replaced by ``mark``; n_chars, if it is there, follows the text."""
    out = docs.mapInArrow(_redactor(mark), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
