"""Text rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repograph import constants as K
from repograph.functions.ids import strip

# Fixed value: the line ends of the excerpt rule.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last dotted suffix of the file name, lower case; empty when there is none."""

    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1))


def parent_path(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def ancestors(path: Column) -> Column:
    """Every directory above a path, nearest last."""

    parts = F.split(path, "/")
    steps = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(steps, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def module_name(path: Column) -> Column:
    bare = F.regexp_replace(path, r"([^/.][^/]*)\.[^/.]+$", "$1")
    inner = F.regexp_replace(bare, r"(^|/)__init__$", "")
    return F.when(inner == "", file_name(bare)).otherwise(F.replace(inner, F.lit("/"), F.lit(".")))


def relative_module(current: Column, module: Column, level: Column) -> Column:
    """The absolute module that an import with leading dots names."""

    package = F.split(current, r"\.")
    keep = F.greatest(F.lit(0), F.size(package) - F.lit(1) - (level - F.lit(1)))
    base = F.array_join(F.slice(package, F.lit(1), keep), ".")
    named = F.coalesce(module, F.lit(""))
    return F.when(level == 0, named).otherwise(
        F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif(named, F.lit("")))
    )


def signature_shape(kind: Column, signature: Column) -> Column:
    """A signature without its name, so a renamed symbol keeps its shape."""

    return (
        F.when(F.coalesce(signature, F.lit("")) == "", F.lit(None))
        .when(
            kind.isin("FUNCTION", "METHOD", "TEST"),
            F.regexp_replace(signature, r"^(?:async\s+)?[^\(]+", "function"),
        )
        .when(kind == "CLASS", F.lit("class"))
        .otherwise(signature)
    )


def owner_name(qualified: Column) -> Column:
    """Text before the last dot; null when there is none."""

    return F.nullif(F.regexp_extract(qualified, r"^(.*)\.[^.]*$", 1), F.lit(""))


def last_name(qualified: Column) -> Column:
    return F.element_at(F.split(qualified, r"\."), -1)


def display_name(qualified: Column, path: Column, kind: Column) -> Column:
    shown = strip(F.get(F.split(qualified, r" \["), F.lit(0)))
    name = file_name(F.replace(path, F.lit("\\"), F.lit("/")))
    name = F.when(name == ".", F.lit("")).otherwise(name)
    place = kind.isin(*K.CONTAINER_KINDS) | shown.contains("/") | (shown == "")
    symbol = last_name(shown)
    return F.when(
        place,
        F.coalesce(F.nullif(name, F.lit("")), F.nullif(shown, F.lit("")), F.initcap(kind)),
    ).otherwise(F.when(symbol == "", shown).otherwise(symbol))


def group_path(path: Column, depth: str) -> Column:
    posix = F.replace(path, F.lit("\\"), F.lit("/"))
    return posix if depth == "file" else F.split_part(posix, F.lit("/"), F.lit(1))


def entity_name(qualified: Column, kind: Column, path: Column, node_id: Column) -> Column:
    """A readable entity name of at most 256 characters; a cut one ends in its node id."""

    full = F.concat(qualified, F.lit(" ["), F.lower(kind), F.lit("] @ "), path)
    tail = F.concat(F.lit(" … ["), node_id, F.lit("]"))
    short = F.concat(F.substr(full, F.lit(1), F.lit(K.MAX_ENTITY_NAME) - F.length(tail)), tail)
    return F.when(F.length(full) <= K.MAX_ENTITY_NAME, full).otherwise(short)


def tokens(text: Column) -> Column:
    """Lower-case identifiers of a text, each followed by its ``_`` parts."""

    def spread(word: Column) -> Column:
        low = F.lower(word)
        return F.concat(
            F.array(low), F.filter(F.split(low, "_"), lambda p: (p != "") & (p != low))
        )

    found = F.regexp_extract_all(text, F.lit("([A-Za-z_][A-Za-z0-9_]*)"))
    return F.flatten(F.transform(found, spread))


def token_bag(text: Column) -> Column:
    """The same words as :func:`tokens` in no set order; cheaper, for counting."""

    found = F.transform(
        F.regexp_extract_all(text, F.lit("([A-Za-z_][A-Za-z0-9_]*)")), lambda w: F.lower(w)
    )
    joined = F.filter(found, lambda w: w.contains("_"))
    parts = F.transform(
        joined, lambda w: F.filter(F.split(w, "_"), lambda p: (p != "") & (p != w))
    )
    return F.concat(found, F.flatten(parts))


def token_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def truthy(value: Column) -> Column:
    return F.coalesce(F.lower(strip(value.cast("string"))).isin("true", "1", "yes"), F.lit(False))


RECORD_MARKER = "\nRecord JSON:\n"


def record_json(content: Column, stored: Column | None = None) -> Column:
    """The JSON record after the last marker of a card text; an older stored column wins."""

    tail = strip(F.substring_index(content, RECORD_MARKER, -1))
    found = F.when(content.contains(RECORD_MARKER), F.nullif(tail, F.lit("")))
    return found if stored is None else F.coalesce(stored, found)


def excerpt(text: Column, span: Column) -> Column:
    """The text of a span whose columns count UTF-8 bytes; null when it lies outside."""

    lines = F.split(text, LINE_END)
    first, last = span["start_line"], span["end_line"]
    as_bytes = lambda line: F.encode(line, "UTF-8")
    as_text = lambda data: F.decode(data, "UTF-8")
    one = as_text(
        F.substr(
            as_bytes(F.get(lines, first - 1)),
            span["start_column"] + 1,
            F.greatest(span["end_column"] - span["start_column"], F.lit(0)),
        )
    )
    head = as_text(F.substr(as_bytes(F.get(lines, first - 1)), span["start_column"] + 1))
    tail = as_text(F.substr(as_bytes(F.get(lines, last - 1)), F.lit(1), span["end_column"]))
    middle = F.slice(lines, first + 1, F.greatest(last - first - 1, F.lit(0)))
    whole = F.concat(
        head, F.lit("\n"), F.array_join(F.concat(middle, F.array(tail)), "\n")
    )
    inside = span.isNotNull() & (first >= 1) & (last >= first) & (last <= F.size(lines))
    return F.when(inside, F.when(first == last, one).otherwise(whole))


def bounded_excerpt(text: Column) -> Column:
    cut = F.concat(
        F.substr(text, F.lit(1), F.lit(K.MAX_EXCERPT_CHARS - 32)),
        F.lit("\n… [bounded source excerpt]"),
    )
    return F.when(F.length(text) <= K.MAX_EXCERPT_CHARS, text).otherwise(cut)


def valid_span_order(start_line, start_column, end_line, end_column) -> Column:
    """Line numbers from 1, byte columns from 0, the end not before the start."""

    return F.coalesce(
        (start_line >= 1)
        & (start_column >= 0)
        & (end_line >= 1)
        & (end_column >= 0)
        & (
            (end_line > start_line)
            | ((end_line == start_line) & (end_column >= start_column))
        ),
        F.lit(False),
    )


def valid_evidence_span(item: Column) -> Column:
    """Either no part of the range is given, or all four in order."""

    fields = [item[n] for n in ("start_line", "start_column", "end_line", "end_column")]
    none = fields[0].isNull() & fields[1].isNull() & fields[2].isNull() & fields[3].isNull()
    return none | valid_span_order(*fields)


def packed_hash(value: Column) -> Column:
    """A SHA-256 in hex digits as its 32 bytes; a text of another form behind 33 zeros."""

    return F.when(value.rlike(r"\A[0-9a-f]{64}\z"), F.unhex(value)).otherwise(
        F.concat(F.lit(bytes(33)), value.cast("binary")))


def unpacked_hash(value: Column) -> Column:
    return F.when(F.octet_length(value) == 32, F.lower(F.hex(value))).otherwise(
        F.substring(value, 34, 2_147_483_647).cast("string"))
