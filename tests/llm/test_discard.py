"""Tables of a step don't outlive it, and stars are components already."""

from __future__ import annotations

from rollbook.llm import common, langid, minhash, simhash, substring


def test_only_what_the_result_reads_stays(spark, docs, tmp_path, monkeypatch):
    """Operator 7 and the pipeline's near copies keep their rows and labels, operator 8 its cuts; also with hot buckets and large prefix groups."""
    monkeypatch.setattr(minhash, "BUCKET", 200)
    monkeypatch.setattr(substring, "GROUP", 100)
    runs = [(minhash.near_copies, {"marked", "labels", "hot-variants"}), (simhash.near_duplicates, {"fingerprints", "labels", "hot-variants"}), (substring.report, {"cuts"})]
    for k, (run, want) in enumerate(runs):
        monkeypatch.setattr(common, "shared_dir", lambda spark, k=k: f"file://{tmp_path}/{k}")
        assert run(docs).count()
        assert {x.name.rpartition("-")[0] for x in (tmp_path / f"{k}/rollbook").iterdir()} == want


def test_stars_take_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(simhash, "staged", lambda df, label: written.append(label) or common.staged(df, label))
    edges = [(1, 5), (7, 1), (1, 9), (30, 40), (3, 3)]
    found = simhash.components(spark.createDataFrame(edges, "a long, b long"))
    assert {tuple(x) for x in found.collect()} == {(1, 1), (5, 1), (7, 1), (9, 1), (30, 30), (40, 30)}
    assert len(written) == 1


def test_training_makes_no_rows_of_its_sample(spark, docs, monkeypatch):
    """The sample comes as Arrow's buffers; of rows collected there are only the languages."""
    frame, taken = type(docs), []
    monkeypatch.setattr(frame, "collect", lambda self, f=frame.collect: taken.append(self.columns) or f(self))
    model = langid.train(docs, langid.is_training())
    assert model.langs == ["en"] and taken == [["lang", "n"]]
