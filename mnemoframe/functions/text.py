"""Text expressions: tokens, normal forms, hashes, redaction, extraction.

All are built-in expressions unless the docstring says otherwise. A null argument gives null
unless another result is named.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Formats, lists and patterns that results depend on.
EXCLUDED_PATH_GLOBS = (
    "*.env", "*.env.*", "**/credentials*", "**/.credentials*", "**/.git/objects/**", "**/node_modules/**", "**/__pycache__/**",
    "*.key", "*.pem", "**/.ssh/**", "**/.gnupg/**", "*history", "*_history", "*.bak-pre-*",
)
CREDENTIAL_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey", "bearer", "--auth", "authorization:")
SECRET_SHAPES = (r"sk-[A-Za-z0-9_-]{20,}", r"ghp_[A-Za-z0-9]{30,}", r"AKIA[0-9A-Z]{16}", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
REDACTED = "[REDACTED]"
ERROR_LINE = r"(?m)^\s*(?:Traceback \(most recent call last\)|[A-Z][A-Za-z]*(?:Error|Exception)[:\s])"
ERROR_PHRASE = r"(?im)command not found|is not recognized as (?:an|the name)|^fatal:|Segmentation fault|Traceback \(most recent call last\)"
ERROR_MARK = "tool_use_error"
CHAT_SIGNALS = (
    "i don't actually remember", "i don't remember", "fill me in", "no shared past", "no shared session", "no shared history",
    "as an ai", "i'm running on local", "i am running on local", "i don't have any memory", "i can't recall", "let me know what",
    "what's next", "how we looking", "how are we looking",
)
STRUCTURED_KEYS = ('"trigger"', '"action"', '"insight"')
TEST_RAN = (
    r"\bpytest\b", r"\bjest\b", r"\bcargo test\b", r"\bgo test\b", r"\bnpm test\b", r"\byarn test\b", r"\bphpunit\b", r"\bmix test\b",
    r"\bswift test\b", r"continuity_test\.py", r"\btests? (?:passed|pass|green)\b",
)
TEST_PASSED = (
    r"\b\d+ (?:passed|passing)(?:\s*,\s*0 fail)?", r"\b(?:passed|passing|green|ok)\b\s*\d+/\d+", r"\b0 (?:failed|failures|errors?)\b",
    r"No drift detected", r"All smoke tests? passed", r"All tests? pass(?:ed|ing)",
)
SMOKE = (
    r"\bsmoke[- ]test(?:ed|ing|s)?\b", r"\bverified\b", r"\bend[- ]to[- ]end\b", r"\bsanity[- ]check(?:ed)?\b",
    r"\bconfirmed (?:working|in browser|via .*)\b", r"\bround[- ]trip\b",
)
SHIPPED = (
    r"^- `\d+:\d+:\d+` Wrote `.*\.(py|ts|tsx|js|jsx|go|rs|md|json|yaml|yml|sh|ps1)`",
    r"^- `\d+:\d+:\d+` Edited `.*\.(py|ts|tsx|js|jsx|go|rs|md|json|yaml|yml|sh|ps1)`",
    r"Wrote .*\.py", r"Edited .*\.py",
)
SEARCH_STOP_WORDS = (
    "the", "and", "for", "you", "are", "but", "not", "have", "this", "that", "what", "with", "from", "was", "were", "can", "would",
    "should", "could", "will", "your", "did", "want", "let", "let's", "going", "now", "just", "really", "still", "also",
)
SESSION_TOPIC_STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "if", "for", "to", "of", "in", "on",
    "at", "by", "with", "from", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "this", "that", "these", "those",
    "i", "you", "he", "she", "it", "we", "they", "my", "your", "his", "her",
    "its", "our", "their", "me", "him", "us", "them",
    "py", "js", "ts", "md", "json", "txt", "log", "tmp",
    "cd", "ls", "cat", "echo", "rm", "mv", "cp", "mkdir",
    "import", "from", "def", "class", "return", "if", "else", "for",
    "true", "false", "null", "none", "users", "claude", "c", "home", "tmp", "var",
)
CANDIDATE_TOPIC_STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "if", "for", "to", "of", "in", "on", "at", "by", "with", "from", "is", "are", "was", "were",
    "be", "this", "that", "these", "those", "what", "you", "your", "us", "py", "js", "md", "json", "log", "tmp", "cd", "ls", "cat", "rm",
    "mv", "cp", "mkdir", "echo", "import", "from", "def", "class", "return", "true", "false", "none", "users", "claude", "c", "home", "tmp",
    "var", "projects", "scripts", "_meta", "memory", "path", "sys", "get_connection", "ensure_db",
)
DISTILLER_PROMPTS = ("distil one reusable how-to-act heuristic", "you distil a reusable heuristic from a mistake")
USER_VERBS = (
    (r"\b{user}\s+(?:uses|runs|relies\s+on|loves)\s+([A-Z][\w/_.-]+)", "uses"),
    (r"\b{user}\s+manages\s+([A-Z][\w\s,.-]+?)(?:\.|,| and|;|$)", "manages"),
    (r"\b([A-Z][\w_-]+)\s+(?:built\s+by|written\s+by|by)\s+{user}", "built_by"),
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, in order, with repeats. Null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def word_set(text: Column | str) -> Column:
    """The distinct runs of a-z, 0-9 and ``_`` of the lower-cased text. Null has none."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit("([a-z0-9_]+)"), F.lit(1)))


def topic_words(text: Column | str, stop_words: Sequence[str] = SEARCH_STOP_WORDS) -> Column:
    """Words of three characters and more that begin with a letter, stop words left out."""
    words = F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit("([a-z][a-z0-9_-]{2,})"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(list(stop_words)))


def search_terms(text: Column | str, most: int = 6) -> Column:
    """The first distinct topic words of a prompt."""
    return F.slice(F.array_distinct(topic_words(text)), 1, most)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared part of the union of two arrays of distinct values; 0 if either is empty."""
    a, b = col(a), col(b)
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def normalised(text: Column | str) -> Column:
    """Lower-cased, trimmed, without quote marks, white space collapsed. Null gives an empty text."""
    bare = F.translate(F.btrim(F.lower(F.coalesce(col(text), F.lit("")))), "\"'`‘’“”", "")
    return F.regexp_replace(bare, r"\s+", " ")


def _json_string(text: Column) -> Column:
    """A JSON string of the text as Python writes it, for texts without control characters but tab and line ends."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


@pandas_udf(StringType())
def _ascii_only(texts: pd.Series) -> pd.Series:
    """Non-ASCII characters as JSON escapes; an Arrow function, as no built-in one does this."""
    return texts.map(lambda t: None if t is None else "".join(c if c < "\x7f" else "".join(f"\\u{u:04x}" for u in _utf16(c)) for c in t))


def _utf16(c: str) -> list[int]:
    raw = c.encode("utf-16-be", "surrogatepass")
    return [raw[i] << 8 | raw[i + 1] for i in range(0, len(raw), 2)]


def record_hash(subject: Column | str, predicate: Column | str, obj: Column | str, kind: Column | str, ascii_input: bool = False) -> Column:
    """``sha256:`` and 32 hex digits over the compact JSON of the four normal forms, keys sorted.

    Nulls are empty texts. ``ascii_input`` skips the Arrow function that escapes other characters.
    """
    parts = []
    for name, value in (("kind", kind), ("object", obj), ("predicate", predicate), ("subject", subject)):
        text = _json_string(normalised(value))
        parts.append(F.concat(F.lit(f'"{name}":'), text if ascii_input else _ascii_only(text)))
    canonical = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(canonical, 256), 1, 32))


def event_hash(*parts: Column | str) -> Column:
    """``sha256:`` and 32 hex digits over the parts joined by ``|``. Nulls are empty texts."""
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(col(p), F.lit("")) for p in parts]), 256), 1, 32))


def content_hash(*parts: Column | str, separator: str = "") -> Column:
    """16 hex digits of the MD5 over the parts, nulls as empty texts."""
    return F.substring(F.md5(F.concat_ws(separator, *[F.coalesce(col(p), F.lit("")) for p in parts])), 1, 16)


def text_hash(text: Column | str, digits: int = 16) -> Column:
    return F.substring(F.sha2(col(text), 256), 1, digits)


def slug(text: Column | str, filler: str = "-", most: int = 50, empty: str = "candidate") -> Column:
    """Lower-cased, other characters than letters, digits, ``_`` and ``-`` made one filler, trimmed, cut."""
    bare = F.btrim(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), "[^a-z0-9_-]+", filler), F.lit(filler))
    cut = F.substring(bare, 1, most)
    return F.when(cut == "", F.lit(empty)).otherwise(cut)


def basename(path: Column | str) -> Column:
    return F.substring_index(F.translate(col(path), "\\", "/"), "/", -1)


def one_line(text: Column | str, most: int) -> Column:
    """White space collapsed; cut with an ellipsis where longer than ``most``."""
    flat = F.btrim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…"))).otherwise(flat)


def first_line_with(text: Column | str, term: Column | str, most: int = 200) -> Column:
    """The first line that holds the term in any case, trimmed and cut; empty if none does."""
    lines = F.filter(F.split(col(text), "\r\n|\n|\r"), lambda x: F.contains(F.lower(x), F.lower(col(term))))
    return F.substring(F.btrim(F.coalesce(F.get(lines, F.lit(0)), F.lit(""))), 1, most)


def first_paragraph(text: Column | str) -> Column:
    """The first paragraph that has text and is no heading; empty if there is none."""
    parts = F.filter(F.transform(F.split(col(text), r"\r?\n\s*\r?\n"), lambda p: F.btrim(p)), lambda p: (p != "") & ~F.startswith(p, F.lit("#")))
    return F.coalesce(F.get(parts, F.lit(0)), F.lit(""))


def heading_preview(text: Column | str, headings: int = 8, most: int = 400) -> Column:
    """Up to so many heading lines, then the flattened rest, cut."""
    lines = F.split(col(text), "\r\n|\n|\r")
    heads = F.slice(F.filter(lines, lambda x: x.rlike("^#{1,6} ")), 1, headings)
    rest = F.btrim(F.regexp_replace(F.array_join(F.filter(lines, lambda x: ~x.rlike("^#{1,6} ")), " "), r"\s+", " "))
    return F.substring(F.concat_ws(" | ", F.array_join(heads, " / "), rest), 1, most)


def redacted(text: Column | str) -> Column:
    out = col(text)
    for shape in SECRET_SHAPES:
        out = F.regexp_replace(out, shape, REDACTED.replace("$", r"\$"))
    return out


def names_credential(text: Column | str) -> Column:
    """Whether any credential word occurs, in any case. Null: false."""
    return F.coalesce(F.lower(col(text)).rlike("|".join(re.escape(w) for w in CREDENTIAL_WORDS)), F.lit(False))


def glob_regex(globs: Sequence[str]) -> str:
    """One regex for whole paths that match any of the globs.

    A glob without a slash is held against the base name. ``**`` stands for anything, ``*`` and
    ``?`` for anything but slashes (in a base name for anything).
    """

    def translated(glob: str) -> str:
        within = "/" in glob
        any_, one = ("[^/]*", "[^/]") if within else (".*", ".")
        out = re.sub(r"\*\*/?|\*|\?|[^*?]+", lambda m: {"**/": ".*/?", "**": ".*", "*": any_, "?": one}.get(m[0], re.escape(m[0])), glob)
        return out if within else f"(?:.*/)?{out.replace('.*', '[^/]*')}"

    return "(?s)^(?:" + "|".join(map(translated, globs)) + ")$"


def path_excluded(path: Column | str, globs: Sequence[str] = EXCLUDED_PATH_GLOBS) -> Column:
    """Whether the path matches a glob. Null and empty: false."""
    return F.coalesce(F.translate(col(path), "\\", "/").rlike(glob_regex(globs)), F.lit(False))


def has_error_mark(text: Column | str) -> Column:
    text = F.coalesce(col(text), F.lit(""))
    return text.rlike(ERROR_LINE) | text.rlike(ERROR_PHRASE) | F.contains(text, F.lit(ERROR_MARK))


def looks_like_error(output: Column | str) -> Column:
    """Whether a tool's output shows a failure; of JSON objects stderr is read, then stdout with it."""
    output = col(output)
    # A text that is no object parses to null.
    parsed = F.from_json(output, "stdout string, stderr string", {"mode": "PERMISSIVE"})
    is_object = output.rlike(r"^\s*\{") & F.try_parse_json(output).isNotNull()
    stderr = F.btrim(F.coalesce(parsed["stderr"], F.lit("")))
    both = F.concat(F.coalesce(parsed["stdout"], F.lit("")), F.lit("\n"), stderr)
    return F.coalesce(F.when(is_object, has_error_mark(stderr) | has_error_mark(both)).otherwise(has_error_mark(output)), F.lit(False))


def reads_as_document(text: Column | str) -> Column:
    """Whether a text is prose: no short, structured, question-only or chat text. Null: false."""
    bare = F.btrim(F.coalesce(col(text), F.lit("")))
    low = F.lower(bare)
    bad = (F.length(bare) < 15) | bare.rlike(r"^[\{\[]") | (F.endswith(bare, F.lit("?")) & ~F.contains(bare, F.lit(".")))
    for sign in (*STRUCTURED_KEYS, *CHAT_SIGNALS):
        bad = bad | F.contains(low, F.lit(sign))
    return ~bad


def _hits(text: Column, patterns: Sequence[str]) -> Column:
    counts = [F.regexp_count(text, F.lit(f"(?mi){p}")) for p in patterns]
    return sum(counts[1:], counts[0])


def verification_verdict(text: Column | str) -> Column:
    """``true``, ``false`` or ``unknown``: whether a log shows that the work was verified."""
    text = F.coalesce(col(text), F.lit(""))
    passed, smoke, ran, shipped = (_hits(text, p) for p in (TEST_PASSED, SMOKE, TEST_RAN, SHIPPED))
    sure = (passed >= 1) | ((smoke >= 1) & (ran >= 1)) | (smoke >= 2)
    return F.when(sure, "true").when(shipped >= 1, "false").otherwise("unknown")


def word_boundary(key: str) -> str:
    """A regex for the key as a whole word."""
    return rf"\b{re.escape(key)}\b"


def occurrences(text: Column | str, term: Column | str) -> Column:
    """How often a non-empty term occurs, without overlaps."""
    text, term = col(text), col(term)
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")


@pandas_udf(StringType())
def _cut_bytes(texts: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else t.encode("utf-8", "replace")[:n].decode("utf-8", "ignore") for t, n in zip(texts, most)])


def cut_bytes(text: Column | str, most: int) -> Column:
    """At most so many bytes of UTF-8, cut between characters. Only texts that are cut leave the JVM."""
    text = col(text)
    return F.when(F.octet_length(text) <= most, text).otherwise(_cut_bytes(text, F.lit(most)))


def salvaged_json(text: Column | str) -> Column:
    """The JSON object within a reply as text: fences stripped, else from the first to the last brace; null if none parses."""
    bare = F.btrim(F.regexp_replace(F.btrim(col(text)), r"^```[a-zA-Z]*\s*|\s*```$", ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    whole = F.when(bare.rlike(r"^\{") & F.try_parse_json(bare).isNotNull(), bare)
    return F.coalesce(whole, F.when((inner != "") & F.try_parse_json(inner).isNotNull(), inner))


def duration(seconds: Column | str) -> Column:
    """``2h 5m``, ``5m 3s`` or ``3s``; anything under a second, and null, gives ``1s``."""
    s = F.greatest(F.coalesce(col(seconds).cast("long"), F.lit(1)), F.lit(1))
    h, m = F.call_function("div", s, F.lit(3600)), F.call_function("div", F.pmod(s, F.lit(3600)), F.lit(60))
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, F.pmod(s, F.lit(60)))).otherwise(F.format_string("%ds", s))


def date_in_name(name: Column | str) -> Column:
    """The first ``YYYY-MM-DD`` or ``YYYY_MM_DD`` of a name, if it is a date."""
    found = F.regexp_extract(col(name), r"(\d{4}[-_]\d{2}[-_]\d{2})", 1)
    return F.try_to_date(F.translate(F.nullif(found, F.lit("")), "_", "-"), "yyyy-MM-dd")


def iso_week(day: Column | str) -> Column:
    """``YYYY-Www`` of a date."""
    day = col(day)
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day).cast("int"), F.weekofyear(day))


def user_verb_patterns(user: str) -> list[tuple[str, str]]:
    """(pattern, type) of what is said about a user: uses, manages, built by."""
    return [(p.replace("{user}", re.escape(user)), t) for p, t in USER_VERBS]


def distiller_prompt(text: Column | str) -> Column:
    """Whether a prompt asks to distil a habit: a known wording, or its three telling words. Null: false."""
    low = F.btrim(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"\s+", " "))
    found = F.contains(low, F.lit("distil")) & F.contains(low, F.lit("reusable")) & F.contains(low, F.lit("heuristic"))
    for said in DISTILLER_PROMPTS:
        found = found | F.contains(low, F.lit(said))
    return found
