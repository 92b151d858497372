"""The library that changes by epochs against a plain replay of the same changes."""

import random

import pytest

from quarry.operators.chunking import spans
from quarry.sources.merged import Library

DOC = "doc_id long, title string, status string, text string"


def text(rng, n):
    return " ".join("word" if rng.random() < 0.9 else "end." for _ in range(n))


def plain_chunks(t):
    return [] if t is None else [t[a:b].strip() for a, b in spans(t)]


class Model:
    """Documents as a dict; soft-deleted ones are marked."""

    def __init__(self):
        self.docs = {}

    def rows(self):
        return sorted((i, d[0], d[1], d[2]) for i, d in self.docs.items() if not d[3])

    def chunks(self):
        return sorted((i, k, c) for i, d in self.docs.items() if not d[3] for k, c in enumerate(plain_chunks(d[2])))


def same(lib, model):
    key = lambda rows: sorted(rows, key=repr)
    assert key((r.doc_id, r.title, r.status, r.text) for r in lib.documents().collect()) == key(model.rows())
    assert key((r.doc_id, r.chunk_order, r.chunk) for r in lib.chunks().collect()) == key(model.chunks())


def test_changes_replays_and_snapshots(spark, tmp_path, monkeypatch):
    rng, lib, model, epoch = random.Random(1), Library(spark, f"file://{tmp_path}/lib"), Model(), 0
    same(lib, model)
    ids = lambda some: spark.createDataFrame([(i,) for i in some], "doc_id long")
    for step in range(7):
        if step in (2, 4):
            gone = rng.sample(range(20), 5) + [999]
            for _ in range(2):  # sent twice
                lib.delete(epoch, ids(gone), soft=step == 2)
            for i in gone:
                if step == 4:
                    model.docs.pop(i, None)
                elif i in model.docs:
                    model.docs[i] = (*model.docs[i][:3], True)
        else:
            rows = [(i, f"t{step}", "completed", text(rng, rng.choice((5, 700)))) for i in rng.sample(range(20), 8 if step else 15)]
            if step == 5:  # a writer that dies after its rows, before its commit
                with monkeypatch.context() as m:
                    m.setattr(Library, "_mark", lambda *_: (_ for _ in ()).throw(OSError("gone")))
                    with pytest.raises(OSError):
                        lib.upsert(epoch, spark.createDataFrame([(i, "half", "completed", "half") for i, *_ in rows] + [(500, "half", "x", "x")], DOC))
                same(lib, model)
            lib.upsert(epoch, spark.createDataFrame(rows, DOC))
            model.docs |= {i: (a, b, c, False) for i, a, b, c in rows}
        if step in (1, 3):
            lib.compact()
        if step == 3:
            then = model.rows()
        epoch += 1
    same(lib, model)
    assert sorted((r.doc_id, r.title, r.status, r.text) for r in lib.documents(upto=3).collect()) == then
    lib.compact()
    same(lib, model)


def test_recovery_replaces(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/lib")
    rng = random.Random(2)
    old, new = text(rng, 900), text(rng, 600)
    lib.upsert(0, spark.createDataFrame([(1, "a", "completed", old), (2, "b", "completed", "short")], DOC))
    lib.upsert(1, spark.createDataFrame([(1, "a", "completed", new), (3, "c", "completed", None)], DOC), at=50, chunked=False)
    lib.upsert(2, spark.createDataFrame([(4, "d", "completed", new)], DOC), at=200, chunked=False)
    assert {r.doc_id for r in lib.chunks().collect()} == {2}  # nothing half done is seen
    lib.recover(3, before=100)
    assert {(r.doc_id, r.status) for r in lib.documents().collect()} == {(1, "completed"), (2, "completed"), (3, "completed"), (4, "processing")}
    assert sorted((r.chunk_order, r.chunk) for r in lib.chunks().filter("doc_id = 1").collect()) == list(enumerate(plain_chunks(new)))


def test_a_stream_of_changes(spark, tmp_path):
    schema = f"{DOC}, op string, seq long"
    lib, model, rng = Library(spark, f"file://{tmp_path}/lib"), Model(), random.Random(3)
    (tmp_path / "in").mkdir()
    lib.upsert(0, spark.createDataFrame([(1, "first", "completed", "old text")], DOC))
    model.docs[1] = ("first", "completed", "old text", False)
    seq = 0
    for batch in range(3):
        rows = []
        for _ in range(25):
            seq += 1
            i, op = rng.randrange(9), rng.choice(("upsert", "upsert", "soft", "hard"))
            rows.append((i, f"t{seq}", "completed", text(rng, 4), op, seq))
        last = {r[0]: r for r in sorted(rows, key=lambda r: r[5])}
        for i, title, status, t, op, _ in last.values():  # of a batch the last change of a document counts
            if op == "upsert":
                model.docs[i] = (title, status, t, False)
            elif op == "hard":
                model.docs.pop(i, None)
            elif i in model.docs:
                model.docs[i] = (*model.docs[i][:3], True)
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/b{batch}")
        for f in (tmp_path / f"b{batch}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{batch}.parquet")
        lib.ingest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/cp").awaitTermination()
        same(lib, model)
    before = lib.last_epoch()
    lib.ingest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/cp").awaitTermination()
    assert lib.last_epoch() == before == 3
