"""Text functions as column expressions: tokens of mixed scripts, normal forms, formatted texts, excerpts.

A token is a run of letters and numbers outside the CJK ideographs, in lower case, or a pair of neighbouring ideographs; a run
of one or two ideographs is a token itself.
"""

from __future__ import annotations

import re

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCKS = ["3400-4DBF", "4E00-9FFF", "F900-FAFF", "20000-2A6DF", "2A700-2B73F", "2B740-2B81F", "2B820-2CEAF", "2CEB0-2EBEF", "2EBF0-2EE5F", "30000-3134F", "31350-323AF", "323B0-3347F"]
TOKENIZER = "mixed-cjk-bigram-v2"
EXCERPT = 280

#: Ideographs and other token characters, for Java's regular expressions.
IDEOGRAPHS = "".join("\\x{%s}-\\x{%s}" % tuple(b.split("-")) for b in _BLOCKS)
_RUN = rf"[{IDEOGRAPHS}]+|[\p{{IsAlphabetic}}\p{{N}}&&[^{IDEOGRAPHS}]]+"
#: Runs of texts without ideographs, which all lie from here on.
_PLAIN_RUN, _FROM_IDEOGRAPHS = r"[\p{IsAlphabetic}\p{N}]+", r"[\x{3400}-\x{10FFFF}]"
_NO_TOKEN = rf"[^\p{{IsAlphabetic}}\p{{N}}{IDEOGRAPHS}]+"

_PY_IDEOGRAPHS = "".join("\\U%s-\\U%s" % tuple(x.rjust(8, "0") for x in b.split("-")) for b in _BLOCKS)
_PY_PLAIN_RUN, _PY_FROM_IDEOGRAPHS = regex.compile(r"(?V1)[\p{Alphabetic}\p{N}]+"), re.compile("[\u3400-\U0010ffff]")
_PY_RUN = regex.compile(rf"(?V1)([{_PY_IDEOGRAPHS}]+)|[[\p{{Alphabetic}}\p{{N}}]--[{_PY_IDEOGRAPHS}]]+")


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def tokenize(text: Column) -> Column:
    """Tokens in order; none for null. Texts that can hold no ideograph take a shorter way to the same tokens."""
    text = _text(text)
    runs = F.regexp_extract_all(text, F.lit(_RUN), F.lit(0))
    plain = F.transform(F.regexp_extract_all(text, F.lit(_PLAIN_RUN), F.lit(0)), lambda run: F.lower(run))

    def tokens(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(f"^[{IDEOGRAPHS}]{{3,}}$"), pairs).otherwise(F.array(F.lower(run)))

    return F.when(text.rlike(_FROM_IDEOGRAPHS), F.flatten(F.transform(runs, tokens))).otherwise(plain)


def token_count(text: Column) -> Column:
    """Number of tokens, 1 at least."""
    return F.greatest(F.size(tokenize(text)), F.lit(1))


def stored_tokens(text: Column) -> Column:
    return F.array_join(tokenize(text), " ")


def normal_form(text: Column) -> Column:
    """Lower case, with anything but letters, numbers and ideographs as one space."""
    return F.trim(F.regexp_replace(F.lower(_text(text)), _NO_TOKEN, " "))


def squeezed(text: Column) -> Column:
    """Words set apart by one space."""
    return F.trim(F.regexp_replace(_text(text), r"(?U)\s+", " "))


def query_for_embedding(query: Column) -> Column:
    return F.concat(F.lit("query: "), squeezed(query))


def _line(name: str, value: Column, wanted: Column | None = None) -> Column:
    line = F.concat(F.lit(f"{name}: "), squeezed(value))
    return line if wanted is None else F.when(wanted, line)


def chunk_for_embedding(relative_path: Column, title: Column, heading_path: Column, chunk_text: Column) -> Column:
    """The text of a chunk that is embedded: a line each for path, title, headings and text; absent ones are left out."""
    return F.concat_ws(
        "\n",
        _line("path", relative_path),
        _line("title", title, squeezed(title) != ""),
        _line("headings", F.array_join(heading_path, " > "), F.size(heading_path) > 0),
        _line("text", chunk_text),
    )


def document_for_reranking(relative_path: Column, title: Column, heading_path: Column, excerpt: Column, metadata_json: Column) -> Column:
    """The text of a hit that is embedded for reranking: as for a chunk, with metadata in the order of keys and the excerpt."""
    entries = F.from_json(_text(metadata_json), "map<string,string>")
    keys = F.array_sort(F.map_keys(entries))
    pairs = F.transform(keys, lambda k: F.concat(k, F.lit("="), F.coalesce(F.try_element_at(entries, k), F.lit("null"))))
    return F.concat_ws(
        "\n",
        _line("path", relative_path),
        _line("title", title, squeezed(title) != ""),
        _line("headings", F.array_join(heading_path, " > "), F.size(heading_path) > 0),
        _line("metadata", F.array_join(pairs, ", "), F.size(keys) > 0),
        _line("excerpt", excerpt),
    )


def excerpt(text: Column) -> Column:
    return F.substring(_text(text), 1, EXCERPT)


def coverage(tokens: Column, field: Column) -> Column:
    """Share of tokens (repeats count) that a normal form contains; 0 without tokens."""
    found = F.size(F.filter(tokens, lambda t: F.contains(field, t)))
    return F.when(F.size(tokens) > 0, found / F.size(tokens)).otherwise(F.lit(0.0))


def phrase_bonus(field: Column, phrase: Column, weight: float) -> Column:
    """``weight`` if the normal form contains the phrase and the phrase is not empty, else 0."""
    return F.when((phrase != "") & F.contains(field, phrase), F.lit(weight)).otherwise(F.lit(0.0))


def py_tokens(text: str) -> list[str]:
    """``tokenize`` on the driver or in a Python worker."""
    out: list[str] = []
    for m in _PY_RUN.finditer(text):
        run = m.group()
        if m.group(1) is None:
            out.append(run.lower())
        elif len(run) <= 2:
            out.append(run)
        else:
            out.extend(run[i : i + 2] for i in range(len(run) - 1))
    return out


def py_token_count(text: str) -> int:
    if not _PY_FROM_IDEOGRAPHS.search(text):
        return max(1, len(_PY_PLAIN_RUN.findall(text)))
    n = 0
    for m in _PY_RUN.finditer(text):
        n += 1 if m.group(1) is None else max(1, len(m.group()) - 1)
    return max(1, n)
