import random

import pytest

from strandline.__main__ import main, parser
from strandline.options import FormatOptions
from strandline.sources import results, sinks


def test_modes(spark, tmp_path, capsys):
    rng = random.Random(1)
    genomes = ["".join(rng.choices("ACGT", k=1200)) for _ in range(3)]
    (tmp_path / "g").mkdir()
    (tmp_path / "tax").mkdir()
    for i, g in enumerate(genomes):
        (tmp_path / "g" / f"g{i}.fa").write_text(f">NC_{i:06d}.1 taxid|{5 + i % 2}|\n{g}\n")
    (tmp_path / "tax/nodes.dmp").write_text("1\t|\t1\t|\troot\t|\n2\t|\t1\t|\tgenus\t|\n5\t|\t2\t|\tspecies\t|\n6\t|\t2\t|\tspecies\t|\n")
    (tmp_path / "tax/names.dmp").write_text("".join(f"{i}\t|\tname{i}\t|\t\t|\tscientific name\t|\n" for i in (1, 2, 5, 6)))
    (tmp_path / "tax/merged.dmp").write_text("")
    (tmp_path / "r.fa").write_text("".join(f">NC_{i:06d}.1\n{g[200:400]}\n" for i, g in enumerate(genomes)))
    db, out = str(tmp_path / "db"), str(tmp_path / "out")
    main(["build", db, str(tmp_path / "g/g0.fa"), str(tmp_path / "g/g1.fa"), "--taxonomy", str(tmp_path / "tax"), "--parts", "2"], spark)
    main(["modify", db, str(tmp_path / "g/g2.fa")], spark)
    main(["query", db, str(tmp_path / "r.fa"), "--out", out, "--tophits", "--allhits", "--queryids", "--hits-per-ref", "--abundances", "--abundance-per", "species", "--precision", "--ground-truth", "--align"], spark)
    lines = [r[0] for r in spark.read.text(f"{out}/mapping").collect()]
    assert sum("sequence:NC_" in x for x in lines) == 3 and any("TABLE_LAYOUT" in x for x in lines)
    assert spark.read.text(f"{out}/abundances").count() == 4 and spark.read.text(f"{out}/hits_per_ref").count() == 3
    assert [r["score"] for r in spark.read.parquet(f"{out}/alignments").collect()] == [400] * 3
    assert any("species precision: 100.0%" in r[0] for r in spark.read.text(f"{out}/statistics").collect())
    for n in "12":
        main(["query", db, str(tmp_path / "r.fa"), "--out", f"{out}{n}", "--tophits", "--queryids", "--lowest", "species"], spark)
    merged = [f"{out}{n}.txt" for n in "12"]
    for n, path in zip("12", merged, strict=True):
        rows = sorted((r[0] for r in spark.read.text(f"{out}{n}/mapping").collect()), key=lambda x: not x.startswith("#"))
        (tmp_path / f"out{n}.txt").write_text("\n".join(rows) + "\n")
    assert results.read_results(spark, *merged).where("hits > 0").count() >= 6
    main(["merge", *merged, "--taxonomy", str(tmp_path / "tax"), "--out", f"{out}m", "--abundances"], spark)
    assert sum("species:name" in r[0] for r in spark.read.text(f"{out}m/mapping").collect()) == 3
    main(["query", db, str(tmp_path / "r.fa"), "--out", f"{out}3", "--split-out"], spark)
    assert (tmp_path / "out3/mapping/source=r.fa").is_dir()
    main(["query", db, str(tmp_path / "r.fa"), "--out", f"{out}4", "--lineage", "--taxids", "--locations", "--taxon-coverage", "--lowest", "species", "--highest", "genus", "--hits-per-ref", "--separate-cols"], spark)
    lines = [r[0] for r in spark.read.text(f"{out}4/mapping").collect() if not r[0].startswith("#")]
    assert sorted(x.split("\t|\t")[3:6] for x in lines)[0] == ["species", "name5", "5"] and all("genus\t|\tname2\t|\t2" in x and "\t|\t[" in x for x in lines)
    assert spark.read.parquet(f"{out}4/taxon_coverage").where("rank = 4").first()["tp"] == 3
    assert any("sequence\t|\tNC_000000.1\t|\t-1" in r[0] and r[0].count("\t|\t") > 12 for r in spark.read.text(f"{out}4/hits_per_ref").collect())
    main(["build+query", str(tmp_path / "r.fa"), "--targets", str(tmp_path / "g"), "--taxonomy", str(tmp_path / "tax"), "--out", f"{out}5", "--tophits"], spark)
    assert sum("sequence:NC_" in r[0] for r in spark.read.text(f"{out}5/mapping").collect()) == 3
    assert any("queries: 3" in r[0] for r in spark.read.text(f"{out}5/statistics").collect()) and spark.read.text(f"{out}5/parameters").count() > 10
    for what in ("config", "targets", "lineages", "rank", "statistics", "locations", "featurecounts"):
        main(["info", db, what], spark)
    assert "NC_000002.1" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["merge", "one", "--taxonomy", "t", "--out", "o"], spark)


def test_options():
    with pytest.raises(SystemExit):
        parser().parse_args(["query", "db", "f", "--out", "o", "--lowest", "nothing"])
    assert parser().parse_args(["query", "db", "f", "--out", "o", "--lowest", "superkingdom"]).lowest == 19
    assert FormatOptions(separator="\\t", map_view="none", top_hits=True).normalised() == FormatOptions(separator="\t", map_view="mapped", top_hits=True)


def test_summarise(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# unclassified: 19.02 %\n# classified: 80.98 %\n# species precision: 76.1 %\n# species sensitivity: 50.3 %\n# genus precision: 99 %\n")
    assert tuple(sinks.summarise_results(spark, str(tmp_path / "a.txt")).first())[1:] == (19.02, 80.98, 76.1, 50.3)
