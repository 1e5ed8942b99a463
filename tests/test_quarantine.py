"""Bad lines are kept beside the clean rows, and the batch form of Jaro-Winkler equals the plain one."""

import csv
import random

import numpy as np
import pytest

from tallyworks.functions import text
from tallyworks.sources import quarantine

COLUMNS = ["id", "name", "extra"]


def test_clean_and_quarantined_are_all_lines(spark, tmp_path):
    good = ['1,"a, b",nan', '2, NULL ,z', '3,"say ""hi""",x', '4,5" pipe,y', '5,,', '6,"",é']
    bad = {'7,x,y,too many': "long", '8': "short", '9,"open,x': "quote", '10,"a"b,c': "quote", '11,"a,"b",c': "quote", '12\x01,z': "short", '"\x01"x,1,2': "quote"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,name,extra\n" + "\n".join(good) + "\n\n")
    (tmp_path / "in" / "b.csv").write_text("id,name,extra\r\n" + "\r\n".join(bad))
    out = f"{tmp_path}/out"
    seen = quarantine.load(spark, f"{tmp_path}/in", COLUMNS, out)
    assert seen == {"ok": 6, "short": 2, "long": 1, "quote": 4}
    rows = sorted(map(tuple, quarantine.loaded(spark, out, COLUMNS).collect()))
    assert rows == [("1", "a, b", None), ("2", None, "z"), ("3", 'say "hi"', "x"), ("4", '5" pipe', "y"), ("5", None, None), ("6", None, "é")]
    kept = quarantine.quarantined(spark, out, COLUMNS).collect()
    assert {r._line: r._reason for r in kept} == bad and {r._file.rsplit("/", 1)[1] for r in kept} == {"b.csv"}
    with pytest.raises(ValueError, match="b.csv"):
        quarantine.load(spark, f"{tmp_path}/in", COLUMNS, f"{tmp_path}/none", on_error="abort")
    assert not (tmp_path / "none").exists()
    assert quarantine.load(spark, f"{tmp_path}/in/a.csv", COLUMNS, out, on_error="abort")["ok"] == 6 and quarantine.loaded(spark, out, COLUMNS).count() == 12
    for wrong in ({"sep": "||"}, {"columns": ["id", "_line"]}):
        with pytest.raises(ValueError):
            quarantine.read_checked(spark, out, **({"columns": COLUMNS} | wrong))


@pytest.mark.parametrize("sep", [",", "|", "\t"])
def test_written_cells_come_back(spark, tmp_path, sep):
    r = random.Random(5)
    cells = [["".join(r.choice('ab"' + sep + " é\\") for _ in range(r.randrange(6))) for _ in range(3)] for _ in range(300)]
    with open(tmp_path / "x.csv", "w", newline="") as f:
        csv.writer(f, delimiter=sep, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows(cells)
    rows = quarantine.read_checked(spark, f"{tmp_path}/x.csv", COLUMNS, sep, header=False).collect()
    assert len(rows) == 300 and not any(x._reason for x in rows)
    want = sorted(tuple(c.strip(" ") or "-" for c in line) for line in cells)
    assert sorted(tuple(x[c] or "-" for c in COLUMNS) for x in rows) == want


def test_batches_of_names_equal_single_pairs(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdé\U0001f600\0 ") for _ in range(r.randrange(n)))
    pairs = [(word(n), word(n)) for n in (1, 3, 6, 12, 40) for _ in range(400)]
    pairs += [(a, a[1:] + a[:1]) for a, _ in pairs[:300]] + [(a, a) for a, _ in pairs[:300]] + [("x" * 5000, "x" * 4999 + "y")]
    want = [text.jaro_winkler(a, b) for a, b in pairs]
    assert np.allclose(text.jaro_winkler_batch(*map(list, zip(*pairs[:-1]))), want[:-1], atol=1e-12)
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs)] + [(-1, None, "a"), (-2, "a", None), (-3, None, None)]
    text.register_jaro_winkler(spark)
    got = {x.i: x.s for x in spark.createDataFrame(rows, "i int, a string, b string").selectExpr("i", "jaro_winkler(a, b) AS s").collect()}
    assert [got[-1], got[-2], got[-3]] == [None] * 3 and np.allclose([got[i] for i in range(len(pairs))], want, atol=1e-12)
