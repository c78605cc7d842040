import hashlib
import json

from docgrid.operators import bundle, captions, enrich
from docgrid.sources import bundles
from docgrid.streaming import arriving_manifests


def element(i, kind="text", **more):
    return {"id": i, "type": kind, "page": 1, "text": "t", "trace": {"parent_chapter_id": "c0", "include_in_rag": True}, **more}


def put(root, doc, run=None, manual=None, toc=None):
    (root / doc).mkdir()
    for name, value in (("run", run), ("manual", manual), ("toc", toc)):
        if value is not None:
            (root / doc / f"{name}.json").write_text(value if isinstance(value, str) else json.dumps(value))


RUN = {"run_id": "a", "status": "validated", "source": {"pages_total": 2, "detected": {"embedded_outline": True}}, "pipeline": {"profile": "digital_outline", "parser": "docling", "structure_strategy": "embedded_outline"}}
TREE = [element("e0"), {"id": "c0", "type": "chapter", "level": 1, "title": "One", "page": 1, "content": [element("e1"), {"id": "c1", "type": "chapter", "level": 2, "title": "In", "page": 2, "content": [element("e2", "image", image_path="x.png")]}, element("e3")]}]


def test_read_bundles(spark, tmp_path):
    put(tmp_path, "a", RUN, {"title": "M", "metadata": {"pages_processed": [1, 2]}, "content": TREE}, [{"level": 1, "title": "One", "page": 1, "confidence": 1.0}, {"level": 2, "title": "In", "page": 2}])
    put(tmp_path, "b", "{", {"content": [{"id": 1}]})
    files = bundles.read_files(spark, str(tmp_path))
    failed = {(r.doc_id, r.check_id) for r in bundles.file_checks(files).filter("not passed").collect()}
    assert failed == {("b", c) for c in ("manifest.json", "manifest.contract", "manual.contract", "toc.exists", "toc.json", "toc.contract")}
    nodes = bundles.nodes(files)
    assert [tuple(r) for r in bundles.chapters(nodes).select("ord", "parent_ord", "level", "title", "child_pos").orderBy("ord").collect()] == [(0, None, 1, "One", 1), (1, 0, 2, "In", 1)]
    assert [tuple(r) for r in bundles.elements(nodes).select("element_id", "chapter_ord", "image_path").orderBy("pos").collect()] == [("e0", None, None), ("e1", 0, None), ("e2", 1, "x.png"), ("e3", 0, None)]
    assert bundle.toc_differences(bundles.toc(files), bundles.chapters(nodes)).count() == 0
    assert [(r.doc_id, r.pages_processed) for r in bundles.runs(files).collect()] == [("a", [1, 2])]
    digest = hashlib.sha256()
    for name in ("manual.json", "run.json", "toc.json"):
        digest.update(len(name).to_bytes(8, "big") + name.encode() + (tmp_path / "a" / name).read_bytes() + b"\0")
    got = {r.doc_id: r.sha256 for r in bundle.fingerprint(bundles.fingerprint_files(spark, str(tmp_path))).collect()}
    assert got["a"] == digest.hexdigest() and set(got) == {"a", "b"}


def test_write_once(spark, tmp_path):
    rows = [("a", "toc.json", "[]"), ("a", "x/y.txt", "é"), ("b", "../z", "no")]
    df = spark.createDataFrame(rows, "doc_id string, path string, content string")
    states = lambda d: {r.doc_id: r.state for r in bundles.write_bundles(d, str(tmp_path)).collect()}
    assert states(df) == {"a": "published", "b": "unsafe"}
    assert (tmp_path / "a/x/y.txt").read_text(encoding="utf-8") == "é" and not (tmp_path / "z").exists()
    assert states(df)["a"] == "unchanged" and states(df.filter("path = 'toc.json'")) == {"a": "exists"}
    assert [p.name for p in tmp_path.iterdir()] == ["a"]


def test_arriving(spark, tmp_path):
    put(tmp_path, "a", RUN)
    put(tmp_path, "b", RUN)
    put(tmp_path, "c", "no json")
    q = arriving_manifests(spark, str(tmp_path)).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.doc_id, r.error) for r in spark.table("arrived").collect()} == {("a", None), ("b", "run_id.coherent"), ("c", "manifest.contract")}


def test_enrich(spark):
    def provider():
        good = "\n".join(f"{k}: {v}" for k, v in zip(captions.LABELS, ["sicurezza", "a", "b", "c", "d", "e", "una"], strict=True))

        def ask(element_id, kind, prompt, asset):
            if prompt == "boom":
                raise RuntimeError("no answer")
            return {"bad": "prose", "wire": good.replace("sicurezza", "wiring")}.get(prompt, good)

        return ask

    rows = [("d", str(i), t, inc, None, cap, p, None) for i, (t, inc, cap, p) in enumerate([("image", True, None, "ok"), ("image", True, "old", "ok"), ("table", True, None, "ok"), ("image", False, None, "ok"), ("image", True, None, "boom"), ("image", True, None, "bad"), ("image", True, None, "wire"), ("text", True, None, "ok")])]
    df = spark.createDataFrame(rows, "doc_id string, element_id string, type string, include boolean, exclusion_reason string, caption string, prompt string, asset binary")
    got = {r.element_id: (r.status, r.reason, r.retrievable) for r in enrich.enrich(df, provider).collect()}
    assert got == {
        "0": ("enriched", enrich.VALIDATED, True), "1": ("skipped", enrich.PRESENT, True), "2": ("skipped", enrich.TABLE, True), "3": ("skipped", enrich.EXCLUDED, False), "4": ("failed", "no answer", False),
        "5": ("failed", "caption breaks its contract", False), "6": ("review_required", captions.ELECTRICAL, False),
    }
