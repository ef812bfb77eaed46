import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import types as T

from pairloom.operators.checks import verified_files
from pairloom.sources import structures, tables
from pairloom.streaming import segments


def test_tsv_round_trip(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("id\tv\tn\n007\t1.5\tNA\n008\tNA\t3\nNA\tNaN\t4\n")
    s = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.DoubleType()), T.StructField("n", T.IntegerType())])
    df = tables.read_tsv(spark, str(tmp_path / "a.tsv"), s)
    rows = [tuple(r) for r in df.collect()]
    assert rows == [("007", 1.5, None), ("008", None, 3), (None, None, 4)]
    out = str(tmp_path / "out")
    tables.write_tsv(df, out)
    assert sorted(map(str, (tuple(r) for r in tables.read_tsv(spark, out, s).collect()))) == sorted(map(str, rows))
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_tsv(df, out)
    part = next(p for p in (tmp_path / "out").iterdir() if p.name.endswith(".gz"))
    assert "NA" in gzip.open(part, "rt").read()


def test_side_files(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"P1": [1, 2], "P2": []}')
    assert sorted(map(tuple, tables.read_index_map(spark, str(tmp_path / "m.json")).collect())) == [("P1", 1), ("P1", 2)]
    (tmp_path / "t.txt").write_text("A B\n  C A\n")
    assert sorted(r[0] for r in tables.read_tokens(spark, str(tmp_path / "t.txt")).collect()) == ["A", "B", "C"]
    (tmp_path / "s.txt").write_text("a=1 b=x=y\n")
    assert dict(map(tuple, tables.read_signatures(spark, str(tmp_path / "s.txt")).collect())) == {"a": "1", "b": "x=y"}


def test_manifest(spark, tmp_path):
    root = tmp_path / "data"
    root.mkdir()
    (root / "x.txt").write_text("x")
    (root / "y.txt").write_text("y")
    good = hashlib.sha256(b"x").hexdigest()
    (tmp_path / "sums").write_text(f"{good}  x.txt\n{good} *y.txt\n{good}  z.txt\n")
    got = dict(map(tuple, verified_files(spark, str(root), tables.read_manifest(spark, str(tmp_path / "sums"))).collect()))
    assert got == {"x.txt": True, "y.txt": False, "z.txt": False}


def atom(name, res, x, kind="C", tag="ATOM  "):
    return f"{tag}{1:5d} {name:<4} {res:<3} A{5:4d}    {x:8.3f}{1.0:8.3f}{2.0:8.3f}  1.00  0.00    +0.000 {kind}"


def test_structures(spark, tmp_path):
    (tmp_path / "p.pdbqt").write_text("\n".join(["MODEL 1", "REMARK VINA RESULT:   -7.5  0 0", atom("C1", "LIG", 1.0), atom("H1", "LIG", 2.0, "HD"), atom("G", "LIG", 3.0, "G0"), "ENDMDL", atom("C2", "LIG", 9.0)]))
    poses, atoms = structures.read_pose(spark, str(tmp_path / "p.pdbqt"))
    r = poses.first()
    assert (r["score"], r["heavy_atoms"], r["dummies"]) == (-7.5, 1, 1) and [a["x"] for a in atoms.collect()] == [1.0]
    (tmp_path / "a.pdb").write_text("\n".join([atom("CA", "ALA", 4.0), atom("O", "HOH", 5.0, tag="HETATM"), atom("HB1", "ALA", 6.0)]))
    assert [(a["atom"], a["x"], a["res_no"]) for a in structures.read_pdb(spark, str(tmp_path / "a.pdb")).collect()] == [("CA", 4.0, 5)]
    (tmp_path / "m.mol2").write_text("@<TRIPOS>MOLECULE\nx\n@<TRIPOS>ATOM\n1 C1 0.5 1 2 C.3 1 L 0\n2 H1 0 0 0 H 1 L 0\n@<TRIPOS>BOND\n1 1 2 1\n")
    assert [(a["atom"], a["x"]) for a in structures.read_mol2(spark, str(tmp_path / "m.mol2")).collect()] == [("C1", 0.5)]


def test_logs_and_arrays(spark, tmp_path):
    (tmp_path / "c").write_text("#! FIELDS time cv\n 0.0 1.5\n# note\n\n 1.0 2.5\n")
    assert [r["fields"]["cv"] for r in structures.read_colvar(spark, str(tmp_path / "c")).orderBy("line_no").collect()] == [1.5, 2.5]
    (tmp_path / "s").write_text("STEP0=0 AT0=1,2 KAPPA0=3,4\nARG=a,b\nSTEP1=100 AT1=2,3 KAPPA1=5,6\n")
    assert [(r["k"], r["step"], r["at"]) for r in structures.read_schedule(spark, str(tmp_path / "s")).orderBy("k").collect()] == [(0, 0, [1.0, 2.0]), (1, 100, [2.0, 3.0])]
    np.savez(tmp_path / "z.npz", a=np.arange(3), b=np.ones(2))
    assert {r["name"]: list(r["values"]) for r in structures.read_npz(spark, str(tmp_path / "z.npz")).collect()} == {"a": [0.0, 1.0, 2.0], "b": [1.0, 1.0]}


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.csv").write_text("segment,step,at,value\na,1,2024-01-01 00:00:00,0\na,1,2024-01-01 00:00:00,0\na,2,2024-01-01 00:01:00,0\na,3,2024-01-01 02:00:00,0\n")
    s = segments.unique_rows(segments.read_segments(spark, str(src)))
    q = s.writeStream.format("memory").queryName("rows_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("rows_out").count() == 3
    z = segments.zero_sessions(segments.read_segments(spark, str(src)))
    q = z.writeStream.format("memory").queryName("zero_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["n"] for r in spark.table("zero_out").collect()] == [3]
