"""Scalar functions over columns, each with the exact semantics of the Python string method it stands for.

"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File suffix -> language.
LANGUAGES = {".py": "py", ".js": "js", ".java": "java", ".ts": "ts", ".go": "go", ".html": "html"}
#: White space that Python's str.strip() removes, as a Java class.
_SPACE = r"[\s\x1c-\x1f]"
#: Where Python's str.splitlines() splits.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*)://"
NETLOC = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
REPLY = "answer string, sources array<struct<file: string, name: string, type: string, start_line: int, end_line: int>>"


def strip(c: Column) -> Column:
    """Removes white space of Unicode, and U+001C to U+001F, from both ends."""
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def normalize_content(c: Column) -> Column:
    """[SCL-1] CR LF becomes LF, then ``strip``."""
    return strip(F.replace(c, F.lit("\r\n"), F.lit("\n")))


def file_hash(c: Column) -> Column:
    """[SCL-2] SHA-256 of the normalised content, in hex."""
    return F.sha2(normalize_content(c), 256)


def point_id(file: Column, code: Column) -> Column:
    """[SCL-3] MD5 of ``file:content`` written as a UUID."""
    digest = F.md5(F.concat(file, F.lit(":"), normalize_content(code)))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def suffix(path: Column) -> Column:
    """The suffix of a path: from the last dot of its last part, unless only dots come before it."""
    return F.regexp_extract(path, r"(?:^|/)\.*[^/.][^/]*?(\.[^/.]*)$", 1)


def language(path: Column) -> Column:
    """[FLT-1, SCL-4] Language of a path by its case-sensitive suffix; null if none is known."""
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), suffix(path))


def is_repo_url(url: Column, host: str = "github.com") -> Column:
    """[FLT-2] http or https, and the network location holds ``host`` (as a substring)."""
    scheme = F.lower(F.regexp_extract(url, SCHEME, 1))
    return scheme.isin("http", "https") & F.contains(F.regexp_extract(url, NETLOC, 1), F.lit(host))


def repo_name(url: Column) -> tuple[Column, Column]:
    """[SCL-5] (owner, name): the last two parts after all slashes at the end are gone; null if there are fewer."""
    parts = F.split(F.regexp_replace(url, "/+$", ""), "/")
    return F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))


def embed_text(file: Column, name: Column, kind: Column, start: Column, end: Column, scope: Column, code: Column) -> Column:
    """[SCL-6] The text of a chunk that is embedded: labelled lines, all but the first indented by four."""
    head = [("File", file), ("Name", name), ("Type", kind), ("Lines", F.concat_ws("-", start, end)), ("Parent_Scope", scope)]
    lines = [F.concat(F.lit(f"{label}: "), value) for label, value in head]
    return strip(F.concat_ws("\n    ", *lines, code))


def lines(c: Column) -> Column:
    """Lines as str.splitlines() gives them: no empty last line, and none for an empty text."""
    parts = F.split(c, LINE_END, -1)
    return F.when(F.try_element_at(parts, F.lit(-1)) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_count(c: Column) -> Column:
    return F.size(lines(c))


def feed_lines(c: Column) -> Column:
    """Lines as str.split("\\n") gives them: only line feeds part them, and an empty text is one empty line."""
    return F.split(c, "\n", -1)


def feed_line_count(c: Column) -> Column:
    """Number of ``feed_lines``, without the empty one after a line feed at the end."""
    return F.size(feed_lines(c)) - F.endswith(c, F.lit("\n")).cast("int")


def signature(code: Column, cut: Callable[[Column], Column] = lines) -> Column:
    """[SCL-7] The first line that is no annotation, stripped; the word None if there is none. ``cut`` makes lines of a text."""
    plain = F.filter(F.transform(cut(strip(code)), strip), lambda x: ~F.startswith(x, F.lit("@")))
    return F.coalesce(F.get(plain, F.lit(0)), F.lit("None"))


def skeleton_line(kind: Column, code: Column, scope: Column, cut: Callable[[Column], Column] = lines) -> Column:
    """[SCL-7]"""
    return F.concat(kind, F.lit(": "), signature(code, cut), F.lit(",parent:"), scope)


def short_skeleton_line(kind: Column, name: Column) -> Column:
    """[SCL-8]"""
    return F.concat(kind, F.lit(": "), name)


def parse_reply(raw: Column) -> Column:
    """[SCL-11] A model's JSON answer, fenced or not; what is no JSON object becomes the answer itself without sources."""
    text = strip(raw)
    fence = F.lit("```")
    inner = F.get(F.split(text, "```", -1), F.lit(1))
    body = F.when(F.startswith(text, fence), F.regexp_replace(inner, "^json", "")).otherwise(text)
    parsed = F.from_json(strip(body), REPLY)
    none = F.array().cast("array<struct<file: string, name: string, type: string, start_line: int, end_line: int>>")
    is_json = F.startswith(strip(body), F.lit("{")) & (parsed["answer"].isNotNull() | parsed["sources"].isNotNull())
    return F.when(F.coalesce(is_json, F.lit(False)), F.struct(parsed["answer"].alias("answer"), F.coalesce(parsed["sources"], none).alias("sources"))).otherwise(
        F.struct(raw.alias("answer"), none.alias("sources"))
    )


def is_rate_limit(message: Column) -> Column:
    """[SRC-4] The strict test of an error message."""
    return F.lower(message).rlike("rate limit|429|403|quota")


def is_quota_hit(message: Column) -> Column:
    """[SCL-19] The loose test that decides between a retry and the dead letter."""
    return F.lower(message).rlike("quota|rate")


def query_error_status(message: Column) -> Column:
    """[SCL-21] HTTP status of a failed question: 429 for a rate limit or quota, else 500."""
    return F.when(F.lower(message).rlike("rate limit|quota"), 429).otherwise(500)


def truncate_error(message: Column) -> Column:
    """[LIM-1] The first 200 characters."""
    return F.substring(message, 1, 200)


def batches(n: Column, size: int) -> Column:
    """[SCL-20] How many batches of ``size`` hold n items."""
    return F.ceil(n / F.lit(size))


def token_hash(token: Column) -> Column:
    """[SCL-15]"""
    return F.sha2(token, 256)


def expires_at(created: Column, days: int = 7) -> Column:
    """[SCL-18]"""
    return created + F.make_dt_interval(F.lit(days))


def is_uuid(c: Column) -> Column:
    """[SCL-22] The dashed form; case does not matter."""
    return F.lower(c).rlike(UUID)


def progress(fetched: Column, processed: Column, stored: Column, total: Column) -> Column:
    """[AGG-3] Percentage of the three stages, 33, 33 and 34 of 100; 0 without files."""
    parts = [(n.cast("double") / total) * F.lit(weight) for n, weight in ((fetched, 33), (processed, 33), (stored, 34))]
    return F.when(total == 0, 0).otherwise(reduce(Column.__add__, parts).cast("int"))


def wait_for_reset(reset: Column, now: Column) -> Column:
    """[SRC-6] Seconds to wait for a quota's reset, a minute at least."""
    return F.greatest(reset - now + 5, F.lit(60))


def retry_delay(attempt: int, first: float, most: float) -> float:
    """[SRC-3, EMB-4] Seconds before a retry: doubling from ``first`` up to ``most``."""
    return min(most, first * 2 ** max(0, attempt - 1))
