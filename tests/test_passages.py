import pyarrow.parquet as pq
from pyspark.sql import functions as F

from paths import SF001
from quarry.operators import passages as P
from quarry.plans import queries as Q


def _rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_paragraph_boundaries(spark):
    p30, p31 = "x" * 30, "y" * 31
    nine = "\n\n".join([p31] * 9)            # 9 blank-line pieces -> newline split
    ten = "\n\n".join([p31] * 10)             # 10 pieces -> kept
    digits = "1" * 40
    texts = [p30 + "\n" + p31, nine, ten, digits + "\n" + p31, "  a   b  " * 10]
    df = _rows(spark, [(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = [list(r.ps) for r in df.orderBy("id").select(P.paragraphs("t").alias("ps")).collect()]
    assert got == [[p31], [p31] * 9, [p31] * 10, [p31], [" ".join(["a b"] * 10)]]


def test_stanza_boundaries(spark):
    s49, s50 = "a" * 49, "b" * 50
    heading2 = "THE TITLE OF THE BOOK IS HERE AND IT IS LONG\nSECOND LINE"
    heading3 = "THE TITLE OF THE BOOK IS HERE AND IT IS LONG\nSECOND LINE\nthird"
    mixed = "An Ordinary Line Of Text That Is Long Enough Ok\nMORE"
    text = "\n\n".join([s49, s50, heading2, heading3, mixed]) + "\n \n" + s50
    df = _rows(spark, [(text,)], "t string")
    assert list(df.select(P.stanzas("t").alias("s")).first().s) == [s50, heading3, s50]


def test_pack_boundaries(spark):
    cases = [["a" * 1596], ["a" * 1598], ["a" * 800, "b" * 796, "c" * 5], ["a" * 800, "b" * 798, "c" * 5], []]
    df = _rows(spark, [(c,) for c in cases], "ps array<string>")
    got = [list(r.c) for r in df.select(P.pack_chunks("ps").alias("c")).collect()]
    two = "a" * 800 + "\n\n" + "b" * 798
    assert got[0] == ["a" * 1596] and got[1] == ["a" * 1598] and got[4] == []
    assert got[3] == [two, "c" * 5] and "".join(got[2]).replace("\n", "") == "a" * 800 + "b" * 796 + "c" * 5


def check_packed(parts, chunks):
    """Nothing lost or moved; every chunk but the last has reached 1,600
    characters, and not before its last part."""
    assert "".join(chunks).replace("\n\n", "") == "".join(parts).replace("\n\n", "")
    for c in chunks[:-1]:
        assert len(c) + 2 >= 1600


def test_documents_chunks_keep_every_paragraph(spark):
    paragraphs, chunks = {}, {}
    for store, rows in ((paragraphs, Q.document_paragraphs(spark, SF001)), (chunks, Q.pack_chunks(spark, SF001))):
        for r in rows.collect():
            store.setdefault(r.doc_id, {})[r.passage_no] = r.text
    assert paragraphs.keys() == chunks.keys()
    for d, ps in paragraphs.items():
        assert sorted(ps) == list(range(len(ps))) and sorted(chunks[d]) == list(range(len(chunks[d])))
        check_packed([ps[i] for i in range(len(ps))], [chunks[d][i] for i in range(len(chunks[d]))])


def test_conversation_stanzas_numbered_across_turns(spark):
    conv = pq.read_table(f"{SF001}/conversations.parquet").to_pandas().sort_values(["conv_id", "turn"])
    got = {}
    for r in Q.txt_stanzas(spark, SF001).collect():
        got.setdefault(r.doc_id, {})[r.passage_no] = r.text
    for cid, g in conv.groupby("conv_id"):
        whole, at = "\n\n".join(g.text.fillna("")), 0
        found = got.get(cid, {})
        assert sorted(found) == list(range(len(found)))
        for i in range(len(found)):      # in text order, each long enough and without a blank line
            at = whole.index(found[i], at) + len(found[i])
            assert len(found[i]) >= 50 and "\n\n" not in found[i]


def test_reflow_keeps_every_word_in_order(spark):
    pages = Q.page_text(spark, SF001).toPandas()
    got = {}
    for r in Q.reflow_pages(spark, SF001).collect():
        got.setdefault(r.doc_id, {})[r.para_no] = r.text
    for doc_id, g in pages.sort_values("page_no").groupby("doc_id"):
        text = " ".join(got[doc_id][i] for i in range(len(got[doc_id])))
        assert text.split() == "".join(g.text).split()


def test_reflow_fuses_lines_across_pages(spark):
    pages = _rows(spark, [(1, 0, "first li"), (1, 1, "ne\n\nnext para"), (1, 2, ""),
                          (1, 3, "\n  tail  ")], "doc_id long, page_no int, text string")
    got = [r.text for r in P.reflow_pages(pages).orderBy("para_no").collect()]
    assert got == ["first line", "next para tail"]


def test_running_total_is_exact_with_small_blocks(spark):
    from quarry.operators.sequence import number_within, running_total
    data = [(k, o, (o * 7) % 5) for k in (1, 2) for o in range(0, 300, 3)] + [(3, 5, 1)]
    df = _rows(spark, data, "k int, o long, v long")
    got = {(r.k, r.o): (r.s, r.n) for r in
           number_within(running_total(df, ["k"], "o", "v", "s", block=8, levels=2),
                         ["k"], "o", "n", block=4).collect()}
    for k in (1, 2, 3):
        rows = sorted((o, v) for kk, o, v in data if kk == k)
        acc = 0
        for i, (o, v) in enumerate(rows):
            assert got[(k, o)] == (acc, i)
            acc += v
