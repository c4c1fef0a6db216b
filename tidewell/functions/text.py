"""Text functions as columns. Null texts behave as empty ones unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul}"
#: A CJK character, with the cheap test first; and a word: ASCII and Latin letters are found without a look at scripts.
_CJK = f"[\\x{{1100}}-\\x{{3ffff}}&&[{CJK}]]"
_WORD = f"[A-Za-z0-9_\\x{{c0}}-\\x{{d6}}\\x{{d8}}-\\x{{f6}}\\x{{f8}}-\\x{{17f}}[\\p{{L}}\\p{{Nd}}&&[^{CJK}]]]+"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def let(value: Column, body) -> Column:
    """Evaluate `value` once per row and bind it in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


# --- tokenizers -------------------------------------------------------------------------------------------------------


def tokens(text: Column | str) -> Column:
    """Words of letters, digits and underscores in lower case; each CJK character is a token of its own."""
    return _all(F.lower(_text(text)), f"{_WORD}|{_CJK}")


def _bigrams(run: Column) -> Column:
    n = F.char_length(run)
    return F.when(n < 2, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2))))


def tokens_bigram(text: Column | str) -> Column:
    """Words as in `tokens`; runs of CJK characters give overlapping pairs, a lone one stays."""
    runs = _all(F.lower(_text(text)), f"{_WORD}|{_CJK}+")
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{CJK}]"), _bigrams(r)).otherwise(F.array(r))))


#: Where `_segments` splits; words without such a place have no segments and need not be split.
_JOINED = "_|[^\\p{Lu}_]\\p{Lu}|\\p{Nd}[^\\p{Nd}_]|[^\\p{Nd}_]\\p{Nd}"


def _segments(word: Column) -> Column:
    """Lower-case humps, snake parts and letter/digit parts of an identifier; none unless there are two of them or more."""
    parts = F.split(word, "_|(?<=[^\\p{Lu}_])(?=\\p{Lu})|(?<=\\p{Nd})(?=[^\\p{Nd}_])|(?<=[^\\p{Nd}_])(?=\\p{Nd})", -1)
    long = F.filter(F.transform(parts, F.lower), lambda p: F.char_length(p) > 1)
    return F.when(F.size(long) < 2, F.array().cast("array<string>")).otherwise(F.filter(long, lambda p: p != F.lower(word)))


def tokens_code(text: Column | str) -> Column:
    """Words followed by the segments of identifiers; CJK characters singly, each but a run's first followed by the pair it
    ends."""
    runs = _all(_text(text), f"{_WORD}|{_CJK}+")
    pairs = lambda r: F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.char_length(r)),
            lambda i: F.when(i == 1, F.array(F.substring(r, i, F.lit(1)))).otherwise(F.array(F.substring(r, i, F.lit(1)), F.substring(r, i - 1, F.lit(2)))),
        )
    )
    word = lambda r: F.when(r.rlike(_JOINED), F.concat(F.array(F.lower(r)), _segments(r))).otherwise(F.array(F.lower(r)))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{CJK}]"), pairs(r)).otherwise(word(r))))


def tokens_hashed(text: Column | str) -> Column:
    """What the hash embedder reads: runs of ASCII letters and digits in their case, CJK characters singly."""
    return _all(_text(text), f"[A-Za-z0-9]+|{_CJK}")


def fnv1a32(text: Column | str) -> Column:
    """FNV-1a over the UTF-8 bytes, as a long from 0 to 2**32 - 1."""
    digits = F.hex(_text(text).cast("binary"))
    step = lambda h, i: F.pmod(h.bitwiseXOR(F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long")) * F.lit(16777619), F.lit(4294967296))
    n = (F.length(digits) / 2).cast("int")
    return F.when(n == 0, F.lit(2166136261)).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(2166136261), step))


def unique_terms(terms: Column) -> Column:
    """Distinct terms in the order they first occur."""
    return F.array_distinct(terms)


def query_coverage(query: Column | str, content: Column | str) -> Column:
    """The share of the query's distinct terms that the content has; 0 if there are none."""
    return let(unique_terms(tokens(query)), lambda q: F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, tokens(content))) / F.size(q)))


# --- normal forms and identities ---------------------------------------------------------------------------------------


def normalize_space(text: Column | str) -> Column:
    """White space collapsed to single blanks and trimmed."""
    return F.trim(F.regexp_replace(_text(text), "[\\t\\n\\f\\r ]+", " "))


def content_text(parts: Column) -> Column:
    """The text of a content array: parts (type, text) of type text, joined."""
    return F.array_join(F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"]), "")


def last_user_text(messages: Column) -> Column:
    """The last message (role, content) of a user that is not blank, normalised; null if there is none."""
    texts = F.filter(F.transform(F.filter(messages, lambda m: m["role"] == "user"), lambda m: normalize_space(m["content"])), lambda t: t != "")
    return F.when(F.size(texts) > 0, F.element_at(texts, -1))


def context_hash(messages: Column) -> Column:
    """A fingerprint of a whole conversation."""
    return F.sha2(F.to_json(messages), 256)


def edit_similarity(a: Column, b: Column, most: int = 2048) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty texts, 0 beyond `most` characters."""
    a, b = _text(a), _text(b)
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(1.0)).when(longest > most, F.lit(0.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


TYPES = ("prompt", "context", "tool_pattern", "result", "memory")
SCOPES = ("session", "project", "user")


def slice_id(content: Column | str, kind: str, scope: str = "project") -> Column:
    """16 hex digits over the type's and the scope's number and the content."""
    head = f"{TYPES.index(kind):02x}{SCOPES.index(scope):02x}"
    return F.substring(F.sha2(F.concat(F.unhex(F.lit(head)), _text(content).cast("binary")), 256), 1, 16)


def replay_id(query: Column | str, prefix: str) -> Column:
    """`prefix` and 16 hex digits over the query."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(_text(query), 256), 1, 16))


def content_version(content: Column | str) -> Column:
    return F.sha2(_text(content), 256)


# --- presentation and safety -------------------------------------------------------------------------------------------


def snippet(text: Column | str, query: Column | str, most: int) -> Column:
    """An excerpt of at most `most` characters around the query, else around its first term that occurs; dots mark cuts."""
    compact = normalize_space(text)

    def around(t: Column) -> Column:
        low, q = F.lower(t), F.lower(F.trim(_text(query)))
        terms = F.filter(unique_terms(tokens_bigram(query)), lambda x: (F.char_length(x) > 1) | x.rlike(f"[{CJK}]"))
        places = F.filter(F.transform(terms, lambda x: F.instr(low, x)), lambda p: p > 0)
        at = F.when((q != "") & (F.instr(low, q) > 0), F.instr(low, q)).when(F.size(places) > 0, F.element_at(places, 1)).otherwise(F.lit(1)) - 1
        n = F.char_length(t)
        start = F.greatest(at - most // 2, F.lit(0))
        stop = F.least(start + most, n)
        start = F.when(start + most > n, F.greatest(stop - most, F.lit(0))).otherwise(start)
        cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(t, start + 1, stop - start), F.when(stop < n, "...").otherwise(""))
        return F.when(n <= most, t).otherwise(cut)

    return let(compact, around)


#: The markers around injected blocks. Fixed values.
BLOCK_OPEN, BLOCK_CLOSE = "[reuse]", "[/reuse]"


def escape_markers(text: Column | str, opening: str = BLOCK_OPEN, closing: str = BLOCK_CLOSE) -> Column:
    """Markers inside a text, in any case, get a backslash after their bracket."""
    out = _text(text)
    for marker in (closing, opening):
        pattern = "(?iu)" + "".join(f"\\x{{{ord(c):x}}}" for c in marker)
        out = F.regexp_replace(out, F.lit(pattern), F.lit("[\\\\" + marker[1:]))
    return out


def strip_terminal(text: Column | str) -> Column:
    """Without ANSI, OSC, DCS and C1 sequences; of an unterminated one only its introducer goes."""
    esc, c1 = "\\x1b", "\\x{90}\\x{98}\\x{9d}\\x{9e}\\x{9f}"
    ending = "(?:\\x07|\\x{9c}|\\x1b\\\\)"
    csi = "[^\\x40-\\x7e]*[\\x40-\\x7e]"
    string = f"(?s:.*?){ending}"
    pattern = f"{esc}\\[{csi}|{esc}[\\]P^_X]{string}|{esc}(?![\\[\\]P^_X])[\\x00-\\x7f]|\\x{{9b}}{csi}|[{c1}]{string}|{esc}|[\\x{{9b}}\\x{{9c}}{c1}]"
    return F.regexp_replace(_text(text), pattern, "")


def tsv_cell(text: Column | str) -> Column:
    """A cell without terminal sequences, tabs and line ends, which no spreadsheet reads as a formula."""
    flat = F.regexp_replace(strip_terminal(text), "[\\t\\r\\n]", " ")
    return F.when(flat.rlike("^[=+@-]"), F.concat(F.lit("'"), flat)).otherwise(flat)


def redact_home(text: Column | str) -> Column:
    """Paths of home folders replaced."""
    return F.regexp_replace(_text(text), "(?i)(?:[a-z]:[\\\\/](?:users|documents and settings)[\\\\/][^\\\\/\\s]+|/(?:users|home)/[^/\\s]+)", "<local-home>")


# --- keys, commands and paths ------------------------------------------------------------------------------------------


def subject_key(text: Column | str) -> Column:
    """Dotted key: segments of a-z, 0-9, hyphens and underscores (for blanks), trimmed, empty ones left out."""
    clean = lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[ _]", "_"), "[^a-z0-9_-]", ""), "^[_-]+|[_-]+$", "")
    parts = F.transform(F.split(F.lower(F.trim(_text(text))), "\\."), clean)
    return F.array_join(F.filter(parts, lambda p: p != ""), ".")


def title_key(text: Column | str) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(_text(text), "[^\\p{L}\\p{Nd}]", ""))


#: Commands of which the second word belongs to the head. Fixed values.
COMMAND_FAMILIES = ("cargo", "docker", "git", "go", "make", "npm", "pnpm", "python", "python3", "uv", "yarn")


def command_head(command: Column | str) -> Column:
    """The command's name, of some tools with the subcommand; empty if it is no plain word."""
    fields = F.filter(F.split(_text(command), "\\s+"), lambda x: x != "")
    word = lambda x: F.regexp_replace(x, "^[\"']+|[\"']+$", "")
    plain = lambda x: x.rlike("^[A-Za-z0-9._-]+$")

    def head(f: Column) -> Column:
        first, second = word(F.get(f, F.lit(0))), word(F.get(f, F.lit(1)))
        family = F.lower(first).isin(*COMMAND_FAMILIES) & F.coalesce(plain(second) & ~second.startswith("-"), F.lit(False))
        return F.when(F.size(f) == 0, "").when(~plain(first), "").when(family, F.concat_ws(" ", first, second)).otherwise(first)

    return let(fields, head)


def relative_path(path: Column | str) -> Column:
    """A cleaned relative path; null for absolute ones, homes, addresses, drives and paths that leave their root."""
    p = F.replace(F.trim(F.regexp_replace(_text(path), "^[\"']+|[\"']+$", "")), F.lit("\\"), F.lit("/"))
    bad = lambda x: x.isin("", ".") | x.rlike("^[/~]|://|^.:")

    def cleaned(x: Column) -> Column:
        parts = F.filter(F.split(x, "/"), lambda s: ~s.isin("", "."))
        empty = F.array().cast("array<string>")
        up = lambda a, s: F.when((s == "..") & (F.size(a) > 0) & (F.coalesce(F.element_at(a, -1), F.lit("..")) != ".."), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s)))
        return F.array_join(F.aggregate(parts, empty, up), "/")

    clean = let(p, cleaned)
    return F.when(bad(p), F.lit(None)).otherwise(F.when((clean == "") | (clean == "..") | clean.startswith("../"), F.lit(None)).otherwise(clean))


def subsequence_rank(label: Column | str, query: str) -> Column:
    """0 if the label starts with the query, 1 if the query's characters occur in it in order, else null; case is ignored."""
    low = F.lower(_text(label))
    pattern = "(?s)" + ".*".join("\\x{%x}" % ord(c) for c in query.lower())
    return F.when(low.startswith(query.lower()), 0).when(low.rlike(pattern), 1)


def sort_tools(tools: Column) -> Column:
    """Tool structs by name, those without a name last in their order."""
    placed = F.transform(tools, lambda t, i: F.struct((F.coalesce(t["name"], F.lit("")) == "").alias("unnamed"), F.coalesce(t["name"], F.lit("")).alias("key"), i.alias("at"), t.alias("tool")))
    return F.transform(F.array_sort(placed, lambda a, b: F.when(a["unnamed"] != b["unnamed"], F.when(a["unnamed"], 1).otherwise(-1)).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(a["at"] - b["at"])), lambda x: x["tool"])
