"""Secrets: strings that a vocabulary compresses badly, known digests and identifiers aside.

Candidates are runs of 12 signs or more of key alphabets with letters and digits, or of 20 or more with letters of both
cases in a mix, and password-like runs of letters of both cases, digits and signs such as ! & or %. An = ends a name and
starts a value; only closing ones belong to a run. A byte-pair vocabulary spends many tokens on random strings:
characters per token below `ratio` expose them, for runs under 16 signs below `SHORT_RATIO`. Left out: digests that the
caller knows, or that the text names as such and that have a digest's length, UUIDs, e-mail names, and numbers. Runs of
letters of one case are words to this test: the rare words of any language compress as badly as random letters do. Of an address, what may
hold a key is judged piece by piece: user info, values behind ? and #, and parts of the path of 24 signs or more that are
neither hexadecimal digests nor words and numbers joined by - or _; its host is left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_arrow, slices

RATIO, SHORT_RATIO = 2.3, 1.9
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RUN = re.compile(r"[A-Za-z0-9+/_\-]{12,}={0,2}")
PASSWORD = re.compile(r"(?<![^\s\"'=:<>(\[{])(?=[^\s\"']{0,200}[!@#$%^&*~?])[A-Za-z0-9!@#$%^&*~?+_.\-]{12,}(?![^\s\"'<>)\]},;:])")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
NAMED = re.compile(r"(?<![a-z])(?:md5|sha-?\d*|digest|checksum|commit|etag|revision|fingerprint|integrity)[\"']?\s*[:=#(]?\s*[\"']?(?:sha\d+-)?$", re.IGNORECASE)
SRI = re.compile(r"sha\d+-", re.IGNORECASE)
MAIL = re.compile(r"@[\w-]+(?:\.[\w-]+)+")
AUTHORITY = re.compile(r"[^\s/?#\"<>]*")
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
BASE64_DIGEST = re.compile(r"[A-Za-z0-9+/]{22}==|[A-Za-z0-9+/]{27}=|[A-Za-z0-9+/]{43}=|[A-Za-z0-9+/]{64}|[A-Za-z0-9+/]{86}==")
SLUG = re.compile(r"(?:[A-Z]?[a-z]*|[A-Z]+|\d+)(?:[-_]+(?:[A-Z]?[a-z]*|[A-Z]+|\d+))*")
NAME, PART = re.compile(r"[^=]*=+(?=[^=])"), re.compile(r"[^/=]+")
LONG, LEAST_PATH = 16, 24
_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a .tiktoken file, read once a process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _mixed(s: str) -> bool:
    letters = any(c.isalpha() for c in s)
    if letters and any(c.isdigit() for c in s):
        return True
    turns = sum(a.islower() and b.isupper() for a, b in zip(s, s[1:]))
    return letters and len(s) >= 20 and turns >= len(s) / 6


def _address(text: str, a: int, e: int) -> int | None:
    """Where the authority of the address starts that the run a..e is in; None outside of addresses."""
    start = max(text.rfind(c, 0, a) for c in ' \n\t\r"<>') + 1
    at = text.rfind("://", start, e)
    return None if at < 0 else at + 3


def _pieces(text: str, a: int, e: int, start: int) -> Iterator[tuple[int, int]]:
    """(start, end) of what may be a key in the run a..e of the address whose authority begins at start."""
    a = max(a, start)
    stop = AUTHORITY.match(text, start).end()
    if a < text.rfind("@", start, stop) or text[e : e + 1] == "@":
        yield a, e
    elif max(text.rfind("?", start, a), text.rfind("#", start, a)) >= 0:
        name = NAME.match(text, a, e)
        yield (name.end() if name else a), e
    else:
        for part in PART.finditer(text, max(a, stop), e):
            if len(part.group()) >= LEAST_PATH and not DIGEST.fullmatch(part.group()) and not SLUG.fullmatch(part.group()):
                yield part.span()


def _hidden(s: str, enc, ratio: float) -> float | None:
    """Characters per token, if these are so few that the string is taken for random."""
    per = len(s) / len(enc.encode_ordinary(s))
    return per if per < (ratio if len(s) >= LONG else min(ratio, SHORT_RATIO)) else None


def _runs(text: str, enc, ratio: float, known: frozenset[str]) -> Iterator[tuple[int, int, float]]:
    for m in RUN.finditer(text):
        a, e = m.span()
        if not _mixed(m.group().rstrip("=")):
            continue
        mail = text[e : e + 1] == "@"
        start = _address(text, a, e) if mail or "/" in m.group() or text[max(0, a - 1) : a] in (".", ":", "/", "?", "&", "#", "%", ";", "=") else None
        if start is None and (text.endswith("www.", 0, a) or mail and MAIL.match(text, e) and (text[a - 1 : a] != ":" or text[max(0, a - 7) : a].lower() == "mailto:")):
            continue
        for i, j in [(a, e)] if start is None else _pieces(text, a, e, start):
            s = text[i:j].rstrip("=")
            if len(s) < LONG and start is not None or not _mixed(s) or UUID.fullmatch(s) or s.lower() in known:
                continue
            label = SRI.match(text, i, j)
            own = text[label.end() if label else i : j]
            if (DIGEST.fullmatch(own.rstrip("=")) or BASE64_DIGEST.fullmatch(own)) and (label or NAMED.search(text, max(0, i - 40), i)):
                continue
            per = _hidden(s, enc, ratio)
            if per is not None:
                yield i, j, per


def _passwords(text: str, enc, ratio: float, known: frozenset[str]) -> Iterator[tuple[int, int, float]]:
    for m in PASSWORD.finditer(text):
        s = m.group()
        kinds = (any(map(str.islower, s)), any(map(str.isupper, s)), any(map(str.isdigit, s)))
        if all(kinds) and sum(not c.isalnum() for c in s) <= len(s) / 3 and s.lower() not in known and not ("@" in s and MAIL.search(s)):
            per = _hidden(s, enc, min(ratio, SHORT_RATIO))
            if per is not None:
                yield *m.span(), per


def find(text: str, enc, ratio: float = RATIO, known: frozenset[str] = frozenset()) -> Iterator[tuple[int, int, float]]:
    """(start, end, characters per token) of each secret in the text, in order; of two that overlap the longer."""
    runs = list(_runs(text, enc, ratio, known))
    more = list(_passwords(text, enc, ratio, known)) if any(c in text for c in "!@#$%^&*~?") else []
    if not more:
        yield from runs
        return
    at = -1
    for a, e, per in sorted(runs + more, key=lambda x: (x[0], -x[1])):
        if a >= at:
            yield a, e, per
            at = e


def secrets(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO, known: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, start_char, end_char, chars_per_token, sha256) of each secret; the string itself isn't passed on.

    `known` are digests and identifiers to leave out. Null and empty texts give none; null ids and repeated rows give
    theirs row by row, very long texts are searched whole, an empty table gives no rows. Each place of a secret that
    comes several times is a row.
    """
    skip = frozenset(x.lower() for x in known)

    def run(batches):
        enc = encoder(vocabulary)
        for b in slices(batches):
            rows = [(i, s, e, per, hashlib.sha256(text[s:e].encode()).hexdigest()) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if text for s, e, per in find(text, enc, ratio, skip)]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.string())], ["doc_id", "start_char", "end_char", "chars_per_token", "sha256"])

    return map_arrow(id_text(docs, id_col, text_col), run, "doc_id long, start_char long, end_char long, chars_per_token double, sha256 string")


def redacted(docs: DataFrame, vocabulary: str, text_col: str = "text", ratio: float = RATIO, known: tuple[str, ...] = (), mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret in the text replaced; other columns, null texts and row counts stay."""
    skip = frozenset(x.lower() for x in known)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        enc, out = encoder(vocabulary), []
        for text in texts:
            if text:
                parts, at = [], 0
                for s, e, _ in find(text, enc, ratio, skip):
                    parts += [text[at:s], mark]
                    at = e
                if parts:
                    text = "".join(parts) + text[at:]
            out.append(text)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))
