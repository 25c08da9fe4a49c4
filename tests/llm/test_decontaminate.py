import re

import pytest

from panelyard.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, n=10):
    ws, hit, ids = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        size = min(n, len(iw))
        for i in range(len(iw) - size + 1) if iw else []:
            for j in range(len(ws) - size + 1):
                if ws[j : j + size] == iw[i : i + size]:
                    hit |= set(range(j, j + size))
                    ids.add(item)
    return len(ws), len(hit), sorted(ids - {None})


@pytest.fixture()
def case(prose):
    items = [(k, prose(25)) for k in range(6)] + [(10, "Short ITEM, here"), (11, "ünï"), (12, "..."), (13, None), (14, ""), (15, "a " * 30), (0, "Short item here"), (16, "Éé_x y")]
    long = prose(20000).split()
    long[700:720] = items[2][1].split()[3:23]
    texts = [None, "", "...", items[0][1], prose(30) + " " + items[1][1].upper().replace(" ", ", ") + " " + prose(9), "short--item\nHERE x short item", " ".join(items[3][1].split()[:9]), " ".join(items[3][1].split()[:10]), "a a a a a a a a a a a", "a " * 9, "ÜNÏ ünï", "Éé x Y", " ".join(long), items[0][1] + "日本"]
    return items, texts


@pytest.mark.parametrize("part_bytes", [decontaminate.PART_BYTES, 200])
def test_scan_against_brute_force(spark, docs_of, case, part_bytes):
    items, texts = case
    items = [*items, (None, texts[-1])]
    bench = spark.createDataFrame([*items, *items[:3]], "item_id long, text string")
    out = decontaminate.scan(docs_of([*texts, *texts[3:5]]), bench, part_bytes=part_bytes).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        assert (r.n_words, sum(s.stop - s.first for s in r.word_spans), r.item_ids) == brute(r.text, items), r.text


def test_removal(spark, docs_of, prose):
    item, before, after = prose(14), prose(12), prose(12)
    docs = docs_of([f"{before}. {item.upper()}! {after}", before, None])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    spans = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench).collect()}
    assert spans == {1: f"{before}. ! {after}", 2: before, 3: None}
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench, remove="documents").collect()) == [2, 3]


def test_empty_tables_and_clashing_columns(spark, docs_of):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = docs_of(["x y"])
    assert [r.item_ids for r in decontaminate.scan(docs, bench).collect()] == [[]]
    assert decontaminate.scan(docs.limit(0), bench).count() == 0
    clash = docs.withColumnRenamed("lang", "item_ids").withColumnRenamed("source", "row")
    assert [r.item_ids for r in decontaminate.scan(clash, bench).collect()] == [[]]
    assert [tuple(r) for r in decontaminate.decontaminate(clash, bench).collect()] == [(1, "x y", "en", "src0", 3)]


def test_ids_of_text_and_many_parts(spark, docs_of, prose):
    items = [(f"item-{k}", prose(14)) for k in range(30)]
    texts = [t for _, t in items] + [prose(30)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    out = {r.doc_id: r.item_ids for r in decontaminate.scan(docs_of(texts), bench, part_bytes=200).collect()}
    assert out == {k + 1: brute(t, items)[2] for k, t in enumerate(texts)}


def test_window_sets_stay_small(prose):
    import pickle

    import pyarrow as pa

    text = prose(30_000)
    rows = pa.Table.from_batches(list(decontaminate._item_windows(10)(iter([pa.RecordBatch.from_pydict({"item_id": [1], "text": [text]})]))))
    assert len(pickle.dumps(decontaminate.window_sets(rows, 10))) < 30 * len(text)
