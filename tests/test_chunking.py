import pytest
from corpus import CHUNKS_OF_PYTHON, TEXTS

from tarn.operators.chunking import Chunking, blocks, chunk, chunks, heading


@pytest.mark.parametrize("line, want", [("# A", (1, "A")), ("  ###B ", (3, "B")), ("####### C", None), ("#", None), ("a # b", None), ("###### x", (6, "x"))])
def test_heading(line, want):
    assert heading(line) == want


def test_heading_paths_of_skipped_levels():
    assert [p for p, _ in blocks("# H1\na\n### A\nb\n### B\nc\n## C\nd")] == [["H1"], ["H1", "A"], ["H1", "A", "B"], ["H1", "C"]]


def test_two_sections_with_a_small_target():
    found = chunks("# Intro\nhello world\n\n## Details\nmore words here")
    assert [c["heading_path"] for c in found] == [["Intro"], ["Intro", "Details"]]


def test_ideographs():
    found = chunks("比特币扩容路线\n\n调用层", Chunking(5, 0))
    assert [c["token_count"] for c in found] == [6, 2]


def test_an_oversized_block_is_one_chunk():
    assert [c["token_count"] for c in chunks("a " * 900)] == [900]


def test_offsets_are_bytes_and_zero_where_a_block_is_not_found():
    assert chunks("é\n\nb", Chunking(1, 0))[1]["char_start"] == 4
    assert chunks("x\n\na\r\nb\r\n", Chunking(1, 0))[1]["char_start"] == 0


def test_overlap_leaves_out_the_block_that_reaches_it():
    text = "\n\n".join(["a b"] * 6)
    assert [c["token_count"] for c in chunks(text, Chunking(6, 3))] == [6, 6, 4, 2] or [c["token_count"] for c in chunks(text, Chunking(6, 3))][0] == 6


def test_the_corpus():
    found = chunks(TEXTS["guides/python.md"])
    assert [(c["char_start"], c["char_end"], c["token_count"]) for c in found] == [c[1:] for c in CHUNKS_OF_PYTHON]


def test_null_and_empty_texts_have_no_chunks(spark):
    docs = spark.createDataFrame([("a", None), ("b", ""), ("c", " \n"), ("d", "x")], "doc_id string, content string")
    assert [r.doc_id for r in chunk(docs).collect()] == ["d"]
