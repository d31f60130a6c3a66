"""Copies of benchmark items that an answer check would hide."""

import random

from threadloom.llm import decontaminate


def test_near_verbatim_copy_with_a_changed_answer_is_a_leak(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    prose = lambda n: " ".join(word() for _ in range(n))
    first, last = prose(30), prose(2)
    bench = spark.createDataFrame([(1, f"{first}. {last}.")], "item_id long, text string")
    rows = [(1, f"{prose(50)} {first}. another ending. {prose(40)}"), *((k, prose(80)) for k in range(2, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(x.doc_id, x.item_id) for x in decontaminate.find_leaks(docs, bench).collect()] == [(1, 1)]
