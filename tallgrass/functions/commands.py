"""Shell commands as columns: words with their quotes kept together, and one level of a shell within a shell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

_QUOTED = r"\"[^\"]*\"|'[^']*'"
_WORD = rf"((?:{_QUOTED}|[^\s\"'])+)"

# Shells whose one command is looked into, and the flags that announce it.
SHELLS = ("powershell", "pwsh")
COMMAND_FLAGS = ("-command", "-c")


def words(command: Column | str) -> Column:
    """Words in order, quotes included; blanks inside quotes do not part a word."""
    return F.regexp_extract_all(col(command), F.lit(_WORD), 1)


def is_single(command: Column | str) -> Column:
    """All quotes are closed, and outside of them nothing pipes, chains or redirects."""
    return ~F.regexp_replace(col(command), _QUOTED, "").rlike(r"[|;&<>\"']")


def unquoted(word: Column) -> Column:
    return F.regexp_replace(word, r"^([\"'])([\s\S]*)\1$", "$2")


def program(found: Column) -> Column:
    """Lower-case name of the program of a list of words, without folders and `.exe`; null if there are no words."""
    name = F.replace(unquoted(F.get(found, F.lit(0))), F.lit("\\"), F.lit("/"))
    return F.regexp_replace(F.lower(F.substring_index(name, "/", -1)), r"\.exe$", "")


def unwrapped(command: Column | str) -> Column:
    """What a shell is asked to run, if that is the last word; the command itself if it starts no shell.

    Null if a shell is started in another way. Only one level is taken off.
    """
    found = words(command)
    asked = F.lower(F.try_element_at(found, F.lit(-2))).isin(*COMMAND_FLAGS) & (F.size(found) > 2)
    inner = F.when(asked & is_single(command), unquoted(F.try_element_at(found, F.lit(-1))))
    return F.when(program(found).isin(*SHELLS), inner).otherwise(col(command))


# The forms in which a command names a file that it reads.
_NAME = r"(\"[^\"]+\"|'(?:''|[^'])*'|[^\s;|,)]+)"
READ_FORMS = (
    rf"(?i)\b(?:Get-Content|cat|type)\s+(?:(?:-LiteralPath|-Path)\s+)?{_NAME}",
    rf"(?i)\bPath\(\s*r?{_NAME}\s*\)\.read_(?:text|bytes)\s*\(",
    rf"(?i)\bopen\(\s*r?{_NAME}\s*(?:\)|,\s*(?:mode\s*=\s*)?(?:'r[btx]?'|\"r[btx]?\"))",
)


def names_read(command: Column | str) -> Column:
    """Names of files as a command writes them, form by form and each in order."""
    return F.flatten(F.array(*[F.regexp_extract_all(col(command), F.lit(form), 1) for form in READ_FORMS]))


def inside(name: Column, root: str | None = None) -> Column:
    """The path below root that a name means, with single slashes and no dots; null if it leaves the root.

    Quotes around it go, doubled single quotes are one. A name from the file system's root must begin with root.
    """
    plain = F.replace(F.regexp_replace(name, "^[\"']+|[\"']+$", ""), F.lit("''"), F.lit("'"))
    path = F.regexp_replace(F.replace(plain, F.lit("\\"), F.lit("/")), "/+", "/")
    if root is not None:
        prefix = root.replace("\\", "/").rstrip("/") + "/"
        path = F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))

    def step(done: Column, part: Column) -> Column:
        climbs = (part == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != "..")
        return F.when(climbs, F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))

    kept = F.reduce(parts, F.array().cast("array<string>"), step)
    leaves = path.startswith("/") | path.rlike("^[A-Za-z]:/") | (F.get(kept, F.lit(0)) == "..")
    return F.when(~F.coalesce(leaves, F.lit(False)) & (F.size(kept) > 0), F.concat_ws("/", kept))
