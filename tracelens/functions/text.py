"""Search terms, template filters, and the small predicates on text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOP_WORDS = ("the", "a", "an", "of", "for", "in", "on", "at", "to", "and", "or", "is", "was", "not", "with", "within", "did", "after", "before")
FALSE_TEXTS = ("", "false", "none", "0", "[]", "{}")
AUTHORED_CHARS = 200
INJECTED = (
    "<task-notification>", "<local-command", "<command-name>", "<command-message>", "<system-reminder>",
    "<bash-input>", "<bash-stdout>", "<bash-stderr>", "<user-memory-input>", "<ide_", "[Request interrupted",
)


def term(hay: Column, word: str) -> Column:
    """One search term, whatever the case: ``"a phrase"`` verbatim, ``pre*`` at a word start, else a whole word."""
    h, quoted = F.lower(hay), len(word) > 1 and word[0] == word[-1] == '"'
    w = word.strip('"').lower() if quoted else word.lower()
    if quoted:
        return F.contains(h, F.lit(w))
    if w.endswith("*"):
        return h.rlike(r"(?U)(?<![\w-])\Q" + w[:-1] + r"\E")
    return h.rlike(r"(?U)(?<![\w-])\Q" + w + r"\E(?![\w-])") | F.array_contains(F.split(h, r"\s+"), w)


def all_terms(hay: Column, *words: str) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & term(hay, w)
    return out


def any_term(hay: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | term(hay, w)
    return out


def field_is(value: Column, *wanted: str) -> Column:
    """Equality without case; any of several values."""
    return F.lower(value.cast("string")).isin(*[w.lower() for w in wanted])


def field_has(values: Column, *wanted: str) -> Column:
    """The same against a list column."""
    return F.exists(values, lambda v: F.lower(v).isin(*[w.lower() for w in wanted]))


def flattened(*columns: Column) -> Column:
    """All leaves of a record as one text, for terms without a field."""
    return F.concat_ws(" ", *[c.cast("string") for c in columns])


def truthy(v: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(v.cast("string"))).isin(*FALSE_TEXTS), F.lit(False))


def tokens(s: Column, least: int = 3, keep_stop: bool = False) -> Column:
    """Words worth searching: without punctuation, short and stop words; the first spelling of each, in order."""
    words = F.transform(F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(r"[A-Za-z0-9_.-]+"), F.lit(0)), lambda w: F.regexp_replace(w, r"^[._-]+|[._-]+$", ""))
    words = F.filter(words, lambda w: (F.length(w) >= least) & (F.lit(keep_stop) | ~F.lower(w).isin(*STOP_WORDS)))
    low = F.transform(words, lambda w: F.lower(w))
    return F.filter(words, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)


def quote(s: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(s.cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"'))


def join_and(items: Column) -> Column:
    return F.array_join(items, " AND ")


def join_or(items: Column) -> Column:
    return F.array_join(items, " OR ")


def short(s: Column, n: int = 10) -> Column:
    return F.substring(s.cast("string"), 1, n)


def snake(s: Column) -> Column:
    return F.translate(s, "-", "_")


def kebab(s: Column) -> Column:
    return F.translate(s, "_", "-")


def escape_query(s: Column) -> Column:
    """Search-engine operators behind a backslash."""
    return F.regexp_replace(s, r'([+\-=&|><!(){}\[\]^"~*?:\\/])', r"\\$1")


def slug(s: Column) -> Column:
    kebab_ = F.regexp_replace(F.lower(s), r"[^a-z0-9]+", "-")
    return F.concat(F.regexp_replace(kebab_, r"^-+|-+$", ""), F.lit("-"), F.substring(F.sha1(s.cast("binary")), 1, 8))


def template(parts: str, **columns: Column) -> Column:
    """``"text {name} text"`` with columns in place of the names; a missing value leaves nothing."""
    out = []
    for i, p in enumerate(re.split(r"\{(\w+)\}", parts)):
        out.append(F.coalesce(columns[p].cast("string"), F.lit("")) if i % 2 else F.lit(p))
    return F.concat(*out)


def preview(s: Column, most: int = 300) -> Column:
    n = F.length(s)
    return F.when(n > most, F.concat(F.substring(s, 1, most), F.lit("… ("), n.cast("string"), F.lit(" chars)"))).otherwise(s)


def is_authored(s: Column) -> Column:
    """Content that was written, and no parameter: several lines, or very long."""
    return (F.length(s) > AUTHORED_CHARS) | F.contains(F.trim(s), F.lit("\n"))


def occurs(value: Column, text: Column) -> Column:
    """Equal, or inside a text if it is long enough and no plain number."""
    return (value == text) | ((F.length(value) >= 5) & ~value.rlike(r"^\d+$") & F.contains(text, value))


def server_of(tool: Column) -> Column:
    """``mcp__server__tool`` names its server; all other tools are the session's own."""
    return F.when(tool.rlike("^mcp__.+?__.+$"), F.regexp_extract(tool, "^mcp__(.+?)__(.+)$", 1)).otherwise(F.lit("claude-code"))


def tool_of(tool: Column) -> Column:
    return F.when(tool.rlike("^mcp__.+?__.+$"), F.regexp_extract(tool, "^mcp__(.+?)__(.+)$", 2)).otherwise(tool)


def call_key(server: Column, tool: Column, args: Column) -> Column:
    """A short content key of a call; ``args`` is a map, whose keys are sorted."""
    entries = F.array_sort(F.map_entries(args))
    return F.substring(F.sha1(F.to_json(F.struct(server.alias("server"), tool.alias("tool"), entries.alias("args"))).cast("binary")), 1, 16)


def folded(prompt: Column) -> Column:
    """A key that near-identical prompts share: ids and numbers as ``#``, one space, lower case, 600 characters."""
    s = F.regexp_replace(prompt, r"[A-Z][A-Z0-9]+-\d+|\b\d{4,}\b|[0-9a-f]{7,40}", "#")
    return F.substring(F.lower(F.regexp_replace(s, r"\s+", " ")), 1, 600)


def is_injected(prompt: Column) -> Column:
    """Text that tools put into a conversation, and no prompt of a person."""
    out = F.lit(False)
    for p in INJECTED:
        out = out | F.startswith(F.ltrim(prompt), F.lit(p))
    return out


# Programs that only read, the parts of some that do, programs that may run only a given line, and what joins or redirects commands.
READ_ONLY = (
    "ls", "cat", "head", "tail", "wc", "grep", "egrep", "fgrep", "rg", "find", "file", "stat", "du", "df", "echo", "pwd", "date", "which", "type", "basename", "dirname", "realpath", "readlink", "sort", "uniq",
    "cut", "tr", "awk", "sed", "jq", "yq", "column", "diff", "cmp", "md5", "shasum", "tree", "env", "printenv", "git", "python3", "python", "node", "uv", "npm", "pip", "cargo", "go",
)
SAFE_PARTS = {
    "git": ("log", "show", "grep", "blame", "diff", "status", "branch", "tag", "describe", "rev-parse", "ls-files", "ls-tree", "shortlog", "config", "remote", "cat-file", "count-objects"),
    "npm": ("ls", "list", "view", "outdated"), "pip": ("list", "show", "freeze"), "uv": ("tree", "pip"), "cargo": ("tree", "metadata"), "go": ("list", "version", "env"),
}
INTERPRETERS, LINE_FLAGS = ("python", "python3", "node"), ("-c", "-V", "--version")
JOINS = r"(^|\s)(>|>>|\||&&|;|\$\(|`)"
#: A shell word: plain characters, escaped ones, and quoted parts.
SHELL_WORD = r"""(?s)(?:[^\s"'\\]|\\.|"(?:[^"\\]|\\.)*"|'[^']*')+"""


def shell_words(command: Column) -> Column:
    """The words of a command line without their quotes; null if a quote or an escape is left open."""
    words = F.regexp_extract_all(command, F.lit(SHELL_WORD), F.lit(0))
    open_ = F.regexp_replace(command, SHELL_WORD, "").rlike(r"\S")
    bare = lambda w: F.regexp_replace(F.regexp_replace(w, r"""(?s)"((?:[^"\\]|\\.)*)"|'([^']*)'""", "$1$2"), r"(?s)\\(.)", "$1")
    return F.when(~open_, F.transform(words, bare))


def is_read_only(command: Column) -> Column:
    """Whether a shell command is a single read that may be run again: no joined or redirected commands, a program that
    only reads, one of its parts that do, and an interpreter only with a line of its own or for its version."""
    line = F.trim(command)
    words = shell_words(line)
    program = F.element_at(F.split(F.get(words, F.lit(0)), "/"), -1)
    rest = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    part = F.get(F.filter(rest, lambda w: ~F.startswith(w, F.lit("-"))), F.lit(0))
    ok = program.isin(*READ_ONLY)
    for name, parts in SAFE_PARTS.items():
        ok = F.when(program == name, F.coalesce(part.isin(*parts), F.lit(False))).otherwise(ok)
    ok = F.when(program.isin(*INTERPRETERS), F.arrays_overlap(rest, F.array(*[F.lit(x) for x in LINE_FLAGS]))).otherwise(ok)
    return F.when(F.coalesce(line, F.lit("")) == "", False).when(line.rlike(JOINS), False).otherwise(F.coalesce(ok, F.lit(False)))
