"""Secret scans: Aho-Corasick prefilter, anchored regular expressions near the hits, checksum validation."""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds, in the order in which spans that start together are listed. The first three are the base.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE = KINDS[:3]

# The words and patterns of the kinds. Patterns are matched at a keyword hit only.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
CHECKED = re.compile(r"(?:gh[pousr]_|npm_)[0-9A-Za-z]{36}(?![0-9A-Za-z])")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
JWT_RUN = re.compile(r"eyJ[A-Za-z0-9_-]*")
PEM_HEAD = re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----(\s*+)((?:(?:Proc-Type|DEK-Info):[\x20A-Za-z0-9,-]{1,100}\r?\n)*+)")
PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s]*+")
PEM_END = re.compile(r"-----END (?:[A-Z]+ )?PRIVATE KEY-----")
OPENSSH = b"openssh-key-v1\0"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_BODY = 6, 20, 24, 64

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_HEX = bytes(104 if chr(i) in "0123456789abcdef" else 46 for i in range(256))
_RUN = b"h" * MIN_HEX


@cache
def _keywords():
    import ahocorasick

    found = ahocorasick.Automaton()
    words = [(w, "assign") for w in ASSIGN_WORDS] + [("akia", "access"), ("npm_", "npm"), ("eyj", "jwt"), ("-----begin ", "pem")]
    for w, kind in [*words, *((f"gh{c}_", "github") for c in "pousr")]:
        found.add_word(w, (len(w), kind))
    found.make_automaton()
    return found


def checksum_holds(token: str) -> bool:
    """The last six characters are the CRC-32 of the thirty before them, in base 62."""
    n, tail = zlib.crc32(token[4:34].encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        tail = BASE62[r] + tail
    return token[34:] == tail


def header_holds(token: str) -> bool:
    """The first segment decodes to a JSON object that names an algorithm."""
    head = token.split(".", 1)[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError, binascii.Error):
        return False


def body_holds(headers: str, body: str) -> bool:
    """The body is a key file of its own kind, or a DER sequence of just its declared length; an encrypted one (by its headers) is whole blocks."""
    try:
        data = base64.b64decode("".join(body.split()), validate=True)
    except (ValueError, binascii.Error):
        return False
    if headers:
        return len(data) > 0 and len(data) % 8 == 0
    if data.startswith(OPENSSH):
        return True
    if len(data) < 2 or data[0] != 0x30:
        return False
    wide = data[1] & 0x7F if data[1] & 0x80 else 0
    return 2 + wide + (int.from_bytes(data[2 : 2 + wide]) if wide else data[1]) == len(data)


def key_block(text: str, at: int) -> tuple[int, str, str] | None:
    """Where a private key's block that starts at a place ends, its header lines and its body. Each run is taken once, as a whole."""
    if not (head := PEM_HEAD.match(text, at)):
        return None
    body = PEM_BODY.match(text, head.end())
    blank = 0 if head[2] else len(head[1])  # white space counts as body where no header line is between
    if len(body[0]) + blank < MIN_BODY or not (end := PEM_END.match(text, body.end())):
        return None
    return end.end(), head[2], body[0]


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """The spans of a text as (start, end, kind), in code points and by start."""
    if not text:
        return []
    narrow = text.encode("latin-1", "replace")  # one byte a character, so places stay
    found: list[tuple[int, int, str]] = []
    upto = dict.fromkeys(KINDS, 0)
    hits = sorted((end + 1 - n, kind) for end, (n, kind) in _keywords().iter(narrow.translate(_LOWER).decode("latin-1")))
    for at, kind in hits:
        if at < upto[kind]:
            continue
        if kind == "pem":
            if block := key_block(text, at):
                upto[kind] = block[0]
                if body_holds(*block[1:]):
                    found.append((at, block[0], kind))
            continue
        pattern = {"assign": ASSIGN, "access": ACCESS, "jwt": JWT}.get(kind, CHECKED)
        if not (m := pattern.match(text, at)):
            if kind == "jwt" and (run := JWT_RUN.match(text, at)):
                upto[kind] = run.end()  # what follows this run fails for every later start within it
            continue
        upto[kind] = m.end()
        good = {"assign": lambda m=m: len(m[1]) >= MIN_ASSIGN, "access": lambda m=m: len(m[0]) >= MIN_ACCESS, "jwt": lambda m=m: header_holds(m[0])}.get(kind, lambda m=m: checksum_holds(m[0]))
        if good():
            found.append((at, m.end(), kind))
    shape = narrow.translate(_HEX)
    at = shape.find(_RUN)
    while at >= 0:
        end = shape.find(b".", at)
        end = len(shape) if end < 0 else end
        found.append((at, end, "hex"))
        at = shape.find(_RUN, end)
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


SCHEMA = "doc_id long, spans array<struct<start: int, end: int, kind: string>>"


def find_secrets(docs: DataFrame) -> DataFrame:
    """Returns one row per input row: doc_id and spans (start, end in code points, end exclusive, and kind), by start.

    Null and empty texts have no spans. Very long texts are scanned whole, in time in proportion to their length. Matches of one kind never overlap, those of different kinds may. A match that
    fails its length or checksum still hides what it covers from its own kind. Null ids and repeated rows are kept
    as they are, an empty table gives no rows, other columns are ignored. There is no shuffle.
    """

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "spans": [[{"start": s, "end": e, "kind": k} for s, e, k in scan(t)] for t in b["text"]]})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, SCHEMA)


def listed(spans: F.Column) -> F.Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every span replaced by ``mark`` and n_chars counted anew; all other columns stay. Overlapping spans are one.

    Null and empty texts stay as they are, very long ones are treated whole, repeated rows and null ids are kept, an empty table gives no rows.
    """
    columns = docs.columns

    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            spans, parts, at = scan(t), [], 0
            for s, e, _ in spans:
                if s >= at:
                    parts += [t[at:s], mark]
                at = max(at, e)
            out.append("".join([*parts, t[at:]]) if spans else t)
        return pd.Series(out, dtype=object)

    made = docs.withColumn("text", F.pandas_udf(clean, "string")("text"))
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*columns) if "n_chars" in columns else made


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    out = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return out.select("doc_id", *[n(k) for k in BASE], F.sha2(F.encode(listed(base), "UTF-8"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


#: Places and checksums are beyond SQL; a brute-force test holds them.
SQL = None


def secret_counts(spark, sf_dir: str) -> DataFrame:
    """The part of ``op3_secret_scan`` that SQL can say."""
    return op3_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


_ASSIGN_SQL = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
EXTRA = {
    "secret_counts": (
        secret_counts,
        f"""SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '{_ASSIGN_SQL}', 2), lambda x: len(x) >= 6)) AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 20)) AS n_access,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: len(x) >= 24)) AS n_hex FROM documents""",
    )
}
