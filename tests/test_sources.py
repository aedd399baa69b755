"""Sources that are read in splits."""

import pytest

from textlens.sources import files


@pytest.mark.parametrize("encoding", ["UTF-8", "ISO-8859-1"])
def test_thesaurus_in_splits(spark, tmp_path, encoding):
    want, lines = set(), [encoding]
    for i in range(300):
        senses = [[f"syn{i}x{j}x{k}" for k in range(1 + (i * j) % 5)] for j in range(1 + i % 3)]
        if i == 7:
            senses[0] = [f"blåbær{k}" for k in range(250)]  # senses that fill several splits, and more than a hundred of them
        lines += [f"ørd {i}|{len(senses)}", *[f"{'-' if i % 2 else '(noun)'}|" + "|".join(x) for x in senses], *[""] * (i % 4 == 0)]
        want |= {(f"ørd {i}", x) for s in senses for x in s}
    for name, text in (("a.dat", "\n".join(lines)), ("b.dat", f"{encoding}\r\nhus|1\r\n-|bolig||hjem\r\n")):
        (tmp_path / name).write_bytes(text.encode(encoding))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        found = files.read_thesaurus(spark, str(tmp_path), encoding)
        splits = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
        got = [tuple(r) for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert splits > 10 and set(got) == want | {("hus", "bolig"), ("hus", "hjem")} and len(got) == len(set(got))


def test_thesaurus_round_trip(spark, tmp_path):
    pairs = [("bil", "kjøretøy"), ("bil", "vogn"), ("hus", "bolig"), ("bil", "vogn"), (None, "x"), ("y", None)]
    files.write_thesaurus(spark.createDataFrame(pairs, "word string, synonym string"), str(tmp_path / "t"))
    assert {tuple(r) for r in files.read_thesaurus(spark, str(tmp_path / "t")).collect()} == {p for p in pairs if None not in p}
    files.write_thesaurus(spark.createDataFrame([], "word string, synonym string"), str(tmp_path / "e"))
    assert files.read_thesaurus(spark, str(tmp_path / "e")).collect() == []
