from askwright import cli
from askwright.functions import segment
from askwright.sources import documents, store


def test_documents(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "KB0012345 - x.md").write_text("# Titre d'article\ncorps", encoding="utf-8")
    (tmp_path / "b.html").write_text("<p>A</p><p>B</p>", encoding="utf-8")
    (tmp_path / "c KB0012345.txt").write_bytes(b"Title: caf\xe9\nx")
    (tmp_path / "d.pdf").write_bytes(b"not a pdf")
    rows = {r.source.rsplit("/", 1)[1].replace("%20", " "): r for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert rows["KB0012345 - x.md"].fiche_id == "KB0012345" and rows["KB0012345 - x.md"].title == "Titre d'article"
    assert rows["b.html"].text == "A\n\nB" and rows["c KB0012345.txt"].title == "café" and rows["c KB0012345.txt"].warning
    assert rows["d.pdf"].text is None and rows["d.pdf"].warning


def test_stores(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, ver int")
    new = spark.createDataFrame([(2, None, 1), (3, "c", 1)], "k int, v string, ver int")
    got = lambda df: sorted(map(tuple, df.select("k", "v").collect()))
    assert got(store.merge(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "c")]
    assert got(store.merge(old, new, ["k"], replace=True)) == [(1, "a"), (2, None), (3, "c")]
    table, refused = store.merge_if_version(old, spark.createDataFrame([(1, "z", 1), (2, "y", 9)], "k int, v string, ver int"), ["k"], "ver")
    assert sorted(map(tuple, table.collect())) == [(1, "z", 2), (2, "b", 1)] and [r.k for r in refused.collect()] == [2]
    answers = spark.createDataFrame([("q", "late", 2), ("q", "early", 1)], "request string, answer string, recorded_at int")
    told = {r.request: (r.answer, r.error) for r in store.replay(spark.createDataFrame([("q",), ("p",)], "request string"), answers).collect()}
    assert told == {"q": ("early", None), "p": (None, "not recorded")}
    decisions = spark.createDataFrame([("t", 0, "fiche", ["a"]), ("t", 1, "question", ["b"])], "key string, ord int, kind string, fiches array<string>")
    runs = spark.createDataFrame([("t", 0), ("t", 1), ("t", 2), ("u", 0)], "key string, run int")
    assert sorted((r.key, r.run, r.kind) for r in store.replay_engine(runs, decisions).collect()) == [("t", 0, "fiche"), ("t", 1, "question"), ("t", 2, "fiche"), ("u", 0, "abstain")]


def test_import_align_noise_and_cli(spark, capsys):
    rows = spark.createDataFrame([("1", "t", "x", None), ("1", "t", "y", "z")], "id string, title string, cause string, fix string").coalesce(1)
    got = documents.import_fiches(rows, "id", "title", ["cause", "fix"]).collect()
    assert [r.text for r in got] == ["## cause\nx", "## cause\ny\n\n## fix\nz"] and [r.duplicate for r in got] == [False, True]
    assert segment.align([(0, 10), (20, 30)], [(0, 9), (21, 30), (50, 60)]) == [(0, 0, 0.9), (1, 1, 0.9)]
    assert segment.noise("Réinitialiser le mot", "k") == segment.noise("Réinitialiser le mot", "k")
    assert cli.main(["list"]) == 0 and "bm25_topk" in capsys.readouterr().out and cli.main(["run", "absent", "x"]) == 2
