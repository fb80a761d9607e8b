import itertools
import math

from plinth.llm import handwritten as H


def brute(files, dirs, parent):
    """Marginals of a small tree by enumeration: node -> log evidence, child -> parent."""
    nodes = list(dirs) + list(files)
    evidence = {**dirs, **files}
    total = {n: [0.0] * 5 for n in nodes}
    for x in itertools.product(range(5), repeat=len(nodes)):
        at = dict(zip(nodes, x, strict=True))
        w = math.exp(sum(evidence[n][at[n]] for n in nodes))
        for c, p in parent.items():
            w *= H.COMPATIBLE[at[p]][at[c]]
        for n in nodes:
            total[n][at[n]] += w
    return {n: max(range(5), key=lambda k: total[n][k]) for n in nodes}, {n: max(t) / sum(t) for n, t in total.items()}


def test_marginals_equal_enumeration(spark):
    rows = [("r", "a/x.js", "A", 300, 0), ("r", "a/b/y.js", "A", 2, 0), ("r", "a/b/z.c", "A", 900, 0), ("r", "t.py", "M", 5, 3)]
    df = spark.createDataFrame(rows, "repo string, path string, mode string, insertions bigint, removals bigint")
    got = {r.path: r for r in H.labels(df).collect()}
    # The tree worked out level by level gives the same.
    for r in H.labels(df, whole_tree=0).collect():
        assert r.label == got[r.path].label and math.isclose(r.certainty, got[r.path].certainty, rel_tol=1e-9)
    sizes = {r.path: [r[f"l{k}"] for k in range(5)] for r in H.change_evidence(df, H.learned_sizes(df)).collect()}
    names = {r[0]: r[1:] for r in df.select("path", *H._name_evidence(H.F.col("path"))).collect()}
    ev = {p: [a + b for a, b in zip(sizes[p], names[p], strict=True)] for p in sizes}
    dirs = {r[0]: list(r[1]) for r in spark.createDataFrame([("a",), ("a/b",)], "d string").select("d", H._dir_prior(H.F.col("d"))).collect()}
    dirs[""] = [3.0, 0.0, 0.0, 0.0, 0.0]
    best, sure = brute(ev, dirs, {"a": "", "a/b": "a", "a/x.js": "a", "a/b/y.js": "a/b", "a/b/z.c": "a/b", "t.py": ""})
    for p in ev:
        assert got[p].label == H.LABELS[best[p]]
        assert math.isclose(got[p].certainty, sure[p], rel_tol=1e-6)


def test_content_flags():
    assert H.content_flags(b"// Code generated by x v1. DO NOT EDIT.\nint a;")[0]
    assert H.content_flags("# Automatisch erzeugt mit x\n".encode("utf-16"))[0]
    assert H.content_flags(b"/* bundled copy of libx 1.2, upstream sources imported unmodified */")[1]
    assert not any(H.content_flags(b"// writes the generated files; edit the templates instead\n// decides whether a vendored copy is stale\n// minify() keeps licence comments"))
    assert H.content_flags(b"var a=function(e,t){return e.b(1)};" * 40)[2]
    assert H.content_flags(b"const t = [\n" + b"0x12ab, 0x34cd, 0x56ef, 0x7890,\n" * 50 + b"];")[3]
    assert not any(H.content_flags(b"")) and not any(H.content_flags(None))


def test_trees_siblings_and_edges(spark):
    rows = [("r", f"x/vendor/q/f{k}.c", "A", None, None, "c") for k in range(3)]
    rows += [("r", f"app/generated_reports/v{k}.py", "A", 60, 0, "c") for k in range(12)]
    rows += [("r", None, "A", 5, 0, "c"), (None, "yarn.lock", "M", 10, 4, "c"), ("r", "src/t.go", "A", 60000, 0, "c"), ("r", "/".join("d" * 60) + "/deep.py", "A", 20, 0, "c"), ("r", "", "A", 3, 0, "c"), ("r", "src/g.go", "A", 50, 0, "c")]
    df = spark.createDataFrame(rows, "repo string, path string, mode string, insertions bigint, removals bigint, label string")
    diffs = spark.createDataFrame([("r", [("src/g.go", bytearray(b"// @generated by t 1\n"), 1, 1, "A")]), ("r", None), (None, [])], "repo string, diff_changes array<struct<location string, content binary, insertions int, removals int, kind string>>")
    got = {r.path: r.label for r in H.labels(df, diffs).collect()}
    assert got["x/vendor/q/f0.c"] == "vendored"
    assert got["app/generated_reports/v3.py"] == "handwritten"
    assert (got["yarn.lock"], got["src/t.go"], got["src/g.go"]) == ("generated", "blob", "generated")
    assert got["/".join("d" * 60) + "/deep.py"] == "handwritten"
    assert len(got) == 20
    assert H.labels(df.limit(0), diffs.limit(0)).count() == 0
    assert H.touched(df.drop("label"), H.labels(df, diffs)).where("path = 'yarn.lock'").count() == 1


def test_every_notice_passes_the_hints():
    generated = ["@generated", "Code generated by x", "auto-generated file", "<autogenerated", "automatically produced", "automatically created", "Automatisch erzeugt", "automatisch generiert", "This file was produced by x", "this file is generated"]
    generated += ["Généré automatiquement", "généré automatiquement", "genere automatiquement", "Generado automáticamente por x, no modificar", "generado automaticamente", "machine-generated", "generated by x; don't touch", "generated by " + "x" * 400 + " (do not touch)", "do not edit by hand", "do not edit: " + "y " * 99 + "by hand", "Do not modify, generated"]
    vendored = ["bundled copy of x", "vendored from x", "vendored copy of x v1", "vendored copy of " + "z" * 300 + " version 2", "upstream sources imported", "imported from x 1.2 release", "imported unmodified from upstream", "copied verbatim from project x"]
    for kind, pattern, parts, notes in ((0, H._GENERATED_NOTE, H._GENERATED_PARTS, generated), (1, H._VENDORED_NOTE, H._VENDORED_PARTS, vendored)):
        for note in notes:
            assert H.content_flags(f"// {note}\nint a;".encode())[kind] == H._noted(note.encode(), pattern, parts), note
            assert H._noted(note.lower().encode(), pattern, parts), note
    assert not any(H.content_flags(b"// generated by x\n// the rest is ours, do not worry\nint a;"))


def test_sizes_are_learned_from_settled_changes(spark):
    rows = [("r", f"src/f{k}.c", "A", 7, 0) for k in range(4000)] + [("r", f"vendor/f{k}.c", "A", 7000, 0) for k in range(4000)] + [("r", f"src/x{k}.c", "M", 2, 2) for k in range(100)]
    df = spark.createDataFrame(rows, "repo string, path string, mode string, insertions bigint, removals bigint")
    flagged = spark.createDataFrame([(4, "A", 50_000, 0)] * 4000, "label int, mode string, insertions bigint, removals bigint")
    got = H.learned_sizes(df, flagged)
    for label, n in ((0, 7), (3, 7000), (4, 50_000)):
        assert math.isclose(got[0][label][0], math.log1p(n), abs_tol=0.1) and got[0][label][1] < H.NARROWEST + 0.05
    assert got[0][1] == H.PRIORS[0][1] and got[2][0][0] < H.PRIORS[2][0][0]
    assert H.learned_sizes(df.limit(0)) == H.PRIORS


def test_trees_are_flushed_between_repositories():
    import pandas as pd

    rows = [(f"r{k}", d, depth, parent, False, [0.1 * k, 0.0, 0.0, 1.0, 0.0]) for k in range(9) for d, depth, parent in (("", 0, None), ("a", 1, ""), ("b", 1, ""), ("a/c", 2, "a"))]
    frame = pd.DataFrame(rows, columns=["repo", "dir", "depth", "parent", "silent", "own"])
    whole = pd.concat(H._trees()(iter([frame])))
    parts = pd.concat(H._trees(flush=5)(iter([frame.iloc[k : k + 3] for k in range(0, len(frame), 3)])))
    key = lambda f: {(r, d): [round(x, 12) for x in a] for r, d, a in zip(f["repo"], f["dir"], f["all"], strict=True)}
    assert key(whole) == key(parts) and len(parts) == 36
