"""What the fourth round's review found."""

from test_round3 import documents, same  # noqa: F401

from emendata.operators import custom
from emendata.sources import formats


def test_pairs_whose_equal_runs_lie_aside(same):  # noqa: F811
    """a doubled article, or words dropped on both sides of the first token, make no pair one that tags can't express."""
    texts = ["cd the de of la , to (x) of and , (x) and atwh de (x) ab la and ab the ,.", "and la de and la la ab ab to.", "to la and to cd and and la and la, the atwh the cd cd.", "la de to la la la ab.", "of la, to to to to to to."]
    assert len(same("c11_c12_c16_decoded", documents=documents(*texts))) >= 4


def test_fitting_edits():
    for a, b in (("a b a b", "a x b a b"), ("x a", "x x x x x a"), ("a b .", "p p p p a q q q q b ."), ("a", ""), ("", "a"), ("a b", "b a"), ("a a b", "a b"), ("a b", "a b")):
        a, b = a.split(), b.split()
        assert custom.applied(a, custom.fitting_edits(a, b)) == b
    assert custom.fitting_edits(list("aabab"), list("abab")) == [(0, 1, [])]
    assert custom.fitting_edits(list("ab."), list("ppppaqqqqb.")) == [(0, 3, list("ppppaqqqqb."))]


def test_small_pieces_are_dealt_to_a_bounded_number_of_tasks(spark, tmp_path):
    """a piece of a large file is no task of its own; each row is read once, in batches, with and without filters."""
    lines = [f"s{i} é\tt{i % 7}" for i in range(3000)]
    for k in range(3):
        (tmp_path / f"p{k}.tsv").write_text("\n".join(lines[k * 1000 : (k + 1) * 1000]) + "\n")
    rows = formats.registered(spark).read.format("emendata_pairs").options(kind="tsv", block_bytes=20).load(str(tmp_path))
    pieces = formats.PairReader({"kind": "tsv", "path": str(tmp_path), "block_bytes": "20"}).partitions()
    assert len(pieces) > 1500 and rows.rdd.getNumPartitions() <= 2 * formats.TASKS
    assert sorted(f"{r['source']}\t{r['target']}" for r in rows.collect()) == sorted(lines)
    assert rows.where("target = 't3'").count() == len([x for x in lines if x.endswith("\tt3")])
    assert {r["file"].rsplit("/", 1)[-1] for r in rows.select("file").distinct().collect()} == {"p0.tsv", "p1.tsv", "p2.tsv"}


def test_batches_end_by_rows_and_bytes(tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "BATCH_ROWS", 7)
    monkeypatch.setattr(formats, "MOST_BYTES", 1000)
    (tmp_path / "a.tsv").write_text("".join(f"{'x' * (300 if i < 20 else 1)}\t{i}\n" for i in range(60)))
    reader = formats.RunReader({"kind": "tsv", "path": str(tmp_path), "block_bytes": "50"})
    batches = [b for run in reader.partitions() for b in reader.read(run)]
    assert [x for b in batches for x in b.column("target").to_pylist()] == [str(i) for i in range(60)]
    assert max(b.num_rows for b in batches) <= 7
