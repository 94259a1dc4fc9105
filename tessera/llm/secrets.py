"""Secret scans with structural confirmation.

Three plain formats are reported by their shape alone (``assign``, ``access``,
``hex``). Everything else must prove its structure: a candidate is decoded, and
reported only if the bytes parse as a DER key (nested lengths that fill their
parents exactly, and the leading fields of a known key layout, encrypted keys
included), an OpenSSH key, or the JSON header of a signed token.

Candidates are runs of base64 in either alphabet, of hex digits in any case, and
of hex bytes with colons between them; base64 also over several lines. A key may
start anywhere in a run: it says how long it is, so what touches it before or
after does no harm. From each place where a key can start just the lengths of
its elements are decoded, so a run costs what it is long. PEM blocks are
confirmed the same way by their decoded body.

Edge cases: a null text is empty and has no spans; ids may be null or repeated,
and rows that are equal have equal results; an empty table gives an empty
result; only ``doc_id`` and ``text`` are read, so other columns may have any
name; texts of any length are scanned as a whole, in linear time.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

from pyspark.sql import DataFrame

from tessera.llm.spans import Cover, Span, digest, joined, per_document

KINDS = ("assign", "access", "hex", "der_key", "openssh_key", "signed_token")

# The three base formats.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LENGTH = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
#: A DER sequence in base64 starts like this (0x30 and a length), and OpenSSH's magic like that.
DER_BASE64, OPENSSH_BASE64 = re.compile(r"(?=M[A-I][A-Za-z0-9+/_-])"), "b3BlbnNzaC1rZXktdjEA"
#: From one line of a wrapped body to the next: a line end or a written one, with quotes, commas, indents or reply marks.
LINE_END = r"""(?:(?:\\r)?\\n|(?:["'][\x20\t.,;+\\]*|[\x20\t,;\\]*)(?:\r?\n|\r){1,2})[\x20\t>|#*"']*"""
BREAK = re.compile(LINE_END)
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{{16,}}+{LINE_END})+[A-Za-z0-9+/]+={{0,2}}")
HEX_BYTES = re.compile(r"[0-9a-fA-F]{64,}")
COLON_BYTES = re.compile(r"[0-9a-fA-F]{2}(?::\s*[0-9a-fA-F]{2}){31,}")
DER_HEX = re.compile(r"(?=30[0-8][0-9a-fA-F])")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{12,}+\.[A-Za-z0-9_-]{4,}+\.[A-Za-z0-9_-]{16,}))")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ ){0,4}PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
OPENSSH = b"openssh-key-v1\0"
#: DER tags used by key layouts.
INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30
#: What stands in the outer sequence of a private key: those, and context tags of parameters, attributes and the public key.
KEY_TAGS = frozenset((INTEGER, OCTETS, SEQUENCE, 0xA0, 0xA1, 0x81))
#: Where the ids of password-based encryption schemes start (PKCS#5 and PKCS#12).
ENCRYPTION = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
STANDARD = str.maketrans("-_", "+/")
#: Bytes of a key that are decoded at once.
AT_ONCE = 8192


class Decoded:
    """The bytes of a run from some place on, decoded where they are looked at; nothing beyond the run's end is."""

    def __init__(self, text: str, start: int, end: int, size: int, base64_run: bool) -> None:
        self.text, self.start, self.end, self.size, self.base64_run = text, start, end, size, base64_run

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at: int | slice) -> int | bytes:
        first, last = (at.start, at.stop) if isinstance(at, slice) else (at, at + 1)
        if not self.base64_run:
            part = bytes.fromhex(self.text[self.start + 2 * first : self.start + 2 * last])
        else:
            group = first // 3
            piece = self.text[self.start + 4 * group : min(self.end, self.start + 4 * -(-last // 3))].translate(STANDARD)
            piece = piece[: len(piece) - (len(piece) % 4 == 1)]
            part = base64.b64decode(piece + "=" * (-len(piece) % 4))[first - 3 * group : last - 3 * group]
        return part if isinstance(at, slice) else part[0]


def base_spans(text: str) -> list[Span]:
    """The three base formats, leftmost and non-overlapping within each kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LENGTH]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def der_children(data: bytes | Decoded, start: int = 0, end: int | None = None, tags: frozenset[int] | None = None) -> list[tuple[int, int, int]] | None:
    """(tag, from, to) of consecutive DER elements that fill the range exactly, else None; also None where a tag is not one of ``tags``."""
    end, out = len(data) if end is None else end, []
    while start < end:
        if end - start < 2:
            return None
        tag, length = data[start : start + 2]
        start += 2
        if tags is not None and tag not in tags:
            return None
        if length >= 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or end - start < n:
                return None
            length, start = int.from_bytes(data[start : start + n], "big"), start + n
        if length > end - start:
            return None
        out.append((tag, start, start + length))
        start += length
    return out


def is_der_key(data: bytes | Decoded) -> bool:
    """A SEQUENCE that fills the data and starts as PKCS#1, SEC1 or PKCS#8 private keys do, or as encrypted PKCS#8 keys."""
    top = der_children(data)
    if not top or len(top) != 1 or top[0][0] != SEQUENCE:
        return False
    first = data[top[0][1]] if top[0][2] > top[0][1] else None
    if first not in (INTEGER, SEQUENCE):
        return False
    parts = der_children(data, top[0][1], top[0][2], KEY_TAGS)
    if not parts or len(parts) < 2:
        return False
    if first == SEQUENCE:
        scheme = der_children(data, parts[0][1], parts[0][2])
        if len(parts) != 2 or parts[1][0] != OCTETS or not scheme or scheme[0][0] != OID:
            return False
        return bytes(data[scheme[0][1] : scheme[0][2]]).startswith(ENCRYPTION)
    if parts[0][2] - parts[0][1] != 1:
        return False
    version, tags = data[parts[0][1]], [tag for tag, _, _ in parts]
    if version == 0 and len(parts) >= 9 and set(tags[:9]) == {INTEGER}:
        return True
    if version == 1 and tags[1] == OCTETS and parts[1][2] - parts[1][1] >= 16:
        return True
    if version in (0, 1) and len(parts) >= 3 and tags[1] == SEQUENCE and tags[2] == OCTETS:
        algorithm = der_children(data, parts[1][1], parts[1][2])
        return bool(algorithm) and algorithm[0][0] == OID
    return False


def _decoded(candidate: str) -> bytes | None:
    body = "".join(candidate.split()).rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def confirmed(data: bytes | None) -> str | None:
    """The kind that the decoded bytes prove, if any."""
    if not data:
        return None
    if data.startswith(OPENSSH):
        return "openssh_key"
    return "der_key" if is_der_key(data) else None


def is_signed_token(candidate: str) -> bool:
    """Three url-safe base64 parts; the first is a JSON header that names an algorithm, the second JSON."""
    try:
        head, body, _ = (base64.b64decode(p + "=" * (-len(p) % 4), altchars=b"-_", validate=True) for p in candidate.split("."))
        head, body = json.loads(head), json.loads(body)
    except (binascii.Error, ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def der_size(data: bytes) -> int | None:
    """How many bytes the DER sequence takes that starts with these."""
    if len(data) < 6 or data[0] != SEQUENCE:
        return None
    n = data[1] & 0x7F if data[1] >= 0x80 else 0
    if n > 4 or data[1] == 0x80:
        return None
    return 2 + n + (int.from_bytes(data[2 : 2 + n], "big") if n else data[1])


def _body_chars(head: str) -> int | None:
    """How many base64 characters, without padding, the DER element takes that starts with these."""
    size = der_size(_decoded(head[:8]) or b"")
    return None if size is None else -(-size * 4 // 3)


def wrapped_spans(text: str) -> list[Span]:
    """Keys in base64 over several lines. A DER key says how long it is, so what follows its last line is left out."""
    found = []
    for m in WRAPPED.finditer(text):
        lines, at = [], m.start()
        for end in BREAK.finditer(text, m.start(), m.end()):
            lines.append((at, end.start()))
            at = end.end()
        lines.append((at, m.end()))
        left, i = sum(e - s for s, e in lines), 0
        while i < len(lines):
            start, taken, j, kind = lines[i][0], 0, i, None
            head = text[start : lines[i][1]]
            if (_decoded(head[:20]) or b"").startswith(OPENSSH):
                kind, j = "openssh_key", len(lines)
            elif (need := _body_chars(head)) is not None and need <= left:
                while j < len(lines) and taken < need:
                    taken += len(text[lines[j][0] : lines[j][1]].rstrip("="))
                    j += 1
                if taken == need and j > i + 1:
                    kind = confirmed(_decoded("".join(text[s:e] for s, e in lines[i:j])))
            if kind:
                found.append((kind, start, lines[j - 1][1]))
            for s, e in lines[i : (i := j if kind else i + 1)]:
                left -= e - s
    return found


def _der_span(text: str, start: int, end: int, base64_run: bool) -> int | None:
    """Where the DER key ends that starts here in a run of base64 or hex, if there is one."""
    room = (end - start) * 3 // 4 if base64_run else (end - start) // 2
    head = Decoded(text, start, end, room, base64_run)[0 : min(room, 9)]
    size = der_size(head)
    if size is None or not 16 <= size <= room:
        return None
    # A version or a scheme comes first; most places end here.
    first = head[2 + (head[1] & 0x7F if head[1] >= 0x80 else 0) :][:3]
    if first[:1] != bytes([SEQUENCE]) and first[:2] != bytes([INTEGER, 1]):
        return None
    data = Decoded(text, start, end, size, base64_run)
    # A usual key is decoded at once; of a longer one just what is looked at.
    if not is_der_key(data[0:size] if size <= AT_ONCE else data):
        return None
    return start + (-(-size * 4 // 3) if base64_run else 2 * size)


def base64_spans(text: str) -> list[Span]:
    """Keys in runs of base64 of either alphabet, wherever in the run they start; padding belongs to the key."""
    found = []
    for run in BASE64.finditer(text):
        end, at = run.end() - len(run[0]) + len(run[0].rstrip("=")), run.start()
        magic = text.find(OPENSSH_BASE64, run.start(), run.end())
        if magic >= 0:
            found.append(("openssh_key", magic, run.end()))
        while (m := DER_BASE64.search(text, at, end)) is not None:
            last = _der_span(text, m.start(), end, True)
            at = m.start() + 1
            if last is not None:
                pad = -(last - m.start()) % 4
                at = last
                found.append(("der_key", m.start(), last + (pad if text[last : last + pad] == "=" * pad else 0)))
    return found


def hex_spans(text: str) -> list[Span]:
    """Keys in runs of hex digits of any case, wherever they start, also with colons between the bytes."""
    found = []

    def scan(run: str, place) -> None:
        magic, at = run.lower().find(OPENSSH.hex()), 0
        if magic >= 0:
            found.append(("openssh_key", place(magic), place(len(run) - (len(run) - magic) % 2)))
        while (m := DER_HEX.search(run, at)) is not None:
            last = _der_span(run, m.start(), len(run), False)
            at = m.start() + 1 if last is None else last
            if last is not None:
                found.append(("der_key", place(m.start()), place(last)))

    for run in HEX_BYTES.finditer(text):
        scan(run[0], lambda i, start=run.start(): start + i)
    for run in COLON_BYTES.finditer(text):
        starts = [m.start() + run.start() for m in re.finditer(r"[0-9a-fA-F]{2}", run[0])]
        scan("".join(text[s : s + 2] for s in starts), lambda i, starts=starts: starts[i // 2] if i < 2 * len(starts) and i % 2 == 0 else starts[(i - 1) // 2] + 2 - (i % 2 and 1))
    return found


def structural_spans(text: str) -> list[Span]:
    """Candidates whose decoded structure is confirmed; what lies inside a span found before is not told again."""
    found = []
    if "-----BEGIN " in text:
        found += [(kind, m.start(), m.end()) for m in PEM.finditer(text) if (kind := confirmed(_decoded(m[2])))]
    for more in (wrapped_spans(text), base64_spans(text), hex_spans(text)):
        known = Cover((s, e) for _, s, e in found)
        found += [x for x in more if not known.holds(*x[1:])]
    if "." in text:
        found += [("signed_token", *m.span(1)) for m in TOKEN.finditer(text) if is_signed_token(m[1])]
    return found


def find_secrets(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, by start and then kind."""

    def order(spans: list[Span]) -> list[Span]:
        return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))

    base = base_spans(text)
    return order(base), order(base + structural_spans(text))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: counts per base kind, digest of the base spans, all spans."""

    def rows(texts: list[str]) -> list[tuple]:
        out = []
        for text in texts:
            base, every = find_secrets(text)
            counts = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
            out.append((*counts, digest(base), joined(every)))
        return out

    return per_document(docs, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", rows)
