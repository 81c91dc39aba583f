"""Text expressions. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never count as terms.
STOP_WORDS = [
    "a", "an", "and", "are", "at", "be", "by", "do", "does", "for", "from", "how", "in", "is", "it", "of",
    "on", "or", "the", "this", "to", "was", "where", "why", "with", "file", "code", "handled", "handle",
    "fix", "bug", "repository", "symbol", "component", "concrete", "concise", "explain", "explanation",
    "implementation", "modify", "proving", "name", "used", "already", "works", "give", "not", "required",
]

# Extension to language.
LANGUAGES = {
    ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".tsx": "TSX", ".jsx": "JSX",
    ".html": "HTML", ".css": "CSS", ".json": "JSON", ".toml": "TOML", ".yaml": "YAML",
    ".yml": "YAML", ".md": "Markdown", ".sh": "Shell", ".bash": "Shell", ".ps1": "PowerShell",
}

REDACTED = "[REDACTED]"

#: Category and pattern of what is redacted, in the order of application. No lookaround: any regex engine takes them.
#: A key runs to its END line, or to the end of the text if there is none. A name may have any beginning (db_password),
#: but nothing after it (token_count); a bare value is a word with a letter, or a number of four digits or more.
SECRETS = (
    ("private key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY( BLOCK)?-----[\s\S]*?(-----END [A-Z0-9 ]*PRIVATE KEY( BLOCK)?-----|\z)"),
    ("credential URL", r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@]*:[^\s/@]+@"),
    ("bearer token", r"(?i:bearer)\s+[A-Za-z0-9._~+/-]{8,}=*"),
    (
        "assigned secret",
        r"\b[A-Za-z0-9_]*(?i:password|passwd|secret|api_key|apikey|access_key|token)[\"']?[ \t]*[=:][ \t]*"
        r"(\"[^\"\n]+\"|'[^'\n]+'|[A-Za-z0-9_/+.-]*[A-Za-z][A-Za-z0-9_/+.-]*|[0-9]{4,})",
    ),
)

# Where camel case is cut, and what an identifier is.
_CAMEL_CUTS = ("([a-z0-9])([A-Z])", "([A-Z])([A-Z][a-z])")
_IDENTIFIER = r"([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)"

_LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def token_estimate(text: Column | str) -> Column:
    """A quarter of the UTF-8 bytes, rounded up; null for null."""
    return F.floor((F.octet_length(col(text)) + 3) / 4).cast("long")


def split_lines(text: Column | str) -> Column:
    """Lines at any line end Unicode knows; a last empty line is not one. An empty text has none."""
    parts = F.split(col(text), _LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def words_apart(text: Column | str) -> Column:
    """Camel case cut into words."""
    out = col(text)
    for cut in _CAMEL_CUTS:
        out = F.regexp_replace(out, cut, "$1 $2")
    return out


def terms(text: Column | str) -> Column:
    """Distinct lower-case alphanumeric terms of two characters or more that are not stop words."""
    found = F.array_distinct(F.split(F.lower(words_apart(text)), "[^a-z0-9]+"))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))


def identifiers(text: Column | str) -> Column:
    """Distinct dotted names that are no lower-case stop words."""
    found = F.array_distinct(F.regexp_extract_all(col(text), F.lit(_IDENTIFIER), 1))
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS))


def is_code_shaped(name: Column | str) -> Column:
    return col(name).rlike(r"[._]|[a-z][A-Z]")


def normalised_path(path: Column | str) -> Column:
    """Forward slashes; every leading dot and slash goes, so `.github/x` becomes `github/x`."""
    return F.regexp_replace(F.replace(col(path), F.lit("\\"), F.lit("/")), r"^[./]+", "")


def file_name(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def stem(path: Column | str) -> Column:
    return F.regexp_replace(file_name(path), r"(.)\.[^.]*$", "$1")


def suffix(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]*)$", 1))


def parent(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"^(.*)/[^/]*$", 1)


def language(path: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(table, suffix(path)), F.lit("Other"))


def is_test_path(path: Column | str) -> Column:
    name = file_name(path)
    return (
        name.rlike(r"^test_.*\.py$|_test\.py$|\.(test|spec)\.(js|ts|tsx)$")
        | F.concat(F.lit("/"), col(path)).rlike("/(tests|__tests__)/")
    )


def safe_name(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(text)), "[^a-z0-9-]+", "-"), "^-+|-+$", "")


def squashed(text: Column | str) -> Column:
    """Lower case, white space runs as one space."""
    return F.trim(F.regexp_replace(F.lower(col(text)), r"\s+", " "))


def redacted(text: Column | str) -> Column:
    """Secrets replaced by a marker; line ends inside private keys stay, so line numbers hold."""
    out = col(text)
    for category, pattern in SECRETS:
        if category == "private key":
            # Keys do not nest, so each is replaced by its text, one after the other.
            keys = F.array_distinct(F.regexp_extract_all(out, F.lit(f"({pattern})"), 1))
            out = F.when(out.rlike(pattern), F.reduce(keys, out, lambda rest, key: F.replace(rest, key, _blank(key)))).otherwise(out)
        else:
            out = F.regexp_replace(out, pattern, REDACTED)
    return out


def _blank(key: Column) -> Column:
    lines = F.length(key) - F.length(F.replace(key, F.lit("\n"), F.lit("")))
    return F.concat(F.lit(REDACTED), F.repeat(F.lit("\n"), lines.cast("int")))


def secret_categories(text: Column | str) -> Column:
    """Names of the kinds of secret in the text, sorted."""
    found = [F.when(col(text).rlike(p), F.lit(c)) for c, p in SECRETS]
    return F.array_sort(F.array_compact(F.array(*found)))


def severity(line: Column | str) -> Column:
    """4 for a traceback's head, 3 for an error, 2 for a warning, else 0."""
    return (
        F.when(F.contains(col(line), F.lit("Traceback (most recent call last):")), 4)
        .when(col(line).rlike(r"(?i)\b(?:ERROR|FATAL|FAILED|Exception|AssertionError)\b"), 3)
        .when(col(line).rlike(r"(?i)\bWARN(?:ING)?\b"), 2)
        .otherwise(0)
    )


def common_prefix_length(a: Column | str, b: Column | str) -> Column:
    pairs = F.zip_with(F.split(col(a), ""), F.split(col(b), ""), lambda x, y: x.eqNullSafe(y))
    first = F.array_position(pairs, False)
    return F.when(first > 0, first - 1).otherwise(F.least(F.length(col(a)), F.length(col(b))))


def is_family(a: Column | str, b: Column | str) -> Column:
    """Different words of six letters or more with a common beginning of six, and of 0.7 of the shorter."""
    shorter = F.least(F.length(col(a)), F.length(col(b)))
    share = F.greatest(F.lit(6), F.ceil(0.7 * shorter)).cast("int")
    return (shorter >= 6) & (col(a) != col(b)) & (F.left(col(a), share) == F.left(col(b), share))
