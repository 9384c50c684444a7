"""Near copies of documents that share an id."""

from spanloom.llm import minhash
from tests.llm.test_operators import docs_of, words


def _edit(text):
    return " ".join(["edited", *text.split()[1:]])


def test_texts_under_one_id_are_all_compared(spark):
    a, b, c, d = (words(300, k) for k in range(4))
    rows = [(3, a), (7, _edit(a)), (7, b), (7, c), (7, c), (9, _edit(b)), (11, d), (12, _edit(d)), (13, words(300, 5))]
    docs = docs_of(spark, [(i, t, "en", "s") for i, t in rows])
    got = {r.doc_id: (r.class_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == {3: (3, True), 7: (3, False), 9: (3, False), 11: (11, True), 12: (11, False), 13: (13, True)}
    left = [(r.doc_id, r.text) for r in minhash.drop_near_duplicates(docs).collect()]
    kept_of = lambda *options: sum(x in left for x in options)
    assert len(left) == 5 and (7, c) in left and (13, rows[-1][1]) in left
    assert kept_of((3, a), (7, _edit(a))) == kept_of((7, b), (9, _edit(b))) == kept_of((11, d), (12, _edit(d))) == 1
