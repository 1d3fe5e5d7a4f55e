"""CSV files as a data-frame library reads them."""

import pandas as pd
import pytest

from tabsleuth.sources import io

FILES = {
    "doubled quotes": 'name,note\nx,"a ""quoted"" b"\ny,"plain"\n',
    "line break in quotes": 'id,text,n\n1,"first\nsecond",2\n3,"one",4\n',
    "missing tokens": "n,s\n1,a\nNA,b\n3,null\n,N/A\n",
    "quoted separator in the header": '"a,b";c\n1;2\n3;4\n',
    "separators in fields": 'a\tb\n"x\ty"\t1,5\n"u;v"\t2\n',
    "numbers": "i,d,e,b,z\n1,1.5,1e3,True,007\n-2,.5,inf,False,1d\n+3,2.,-4,true,2\n",
    "header over two lines": '"a\nb",c\n1,2\n',
    "names with dots": "a.b,c d\n1,x\n2,y\n",
}


@pytest.mark.parametrize("name", FILES)
def test_files_read_as_pandas_reads_them(spark, tmp_path, name):
    path = tmp_path / "t.csv"
    path.write_text(FILES[name], encoding="utf-8")
    shape = io.sniff_csv(spark, str(path))
    want = pd.read_csv(path, sep=shape.separator)
    got = io.read_csv_sniff(spark, str(path))
    assert got.columns == list(want.columns)
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in want.itertuples(index=False, name=None)]
    assert [tuple(r) for r in got.collect()] == rows
    kinds = {"int64": "bigint", "float64": "double", "bool": "boolean", "object": "string", "str": "string"}
    for c, t in want.dtypes.items():
        own = dict(got.dtypes)[c]
        assert own == kinds[str(t)] or (own == "bigint" and want[c].isna().any())  # whole numbers stay whole beside a gap


def test_encoding_can_be_given(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes("name;n\nJosé;1\n".encode("latin-1"))
    assert io.sniff_csv(spark, str(path)).encoding == "latin-1"
    assert io.read_csv_sniff(spark, str(path)).first()["name"] == "José"
    assert io.read_csv_sniff(spark, str(path), encoding="latin-1").first()["name"] == "José"


def test_one_column_is_rejected(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('"a,b"\n1\n')
    with pytest.raises(ValueError, match="more than one column"):
        io.sniff_csv(spark, str(path))


def test_formats_by_extension(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a long, b string").coalesce(1)
    df.write.csv(f"{tmp_path}/t.csv", header=True)
    df.write.parquet(f"{tmp_path}/t.parquet")
    df.write.json(f"{tmp_path}/t.json")
    for ext in ("csv", "parquet", "json"):
        assert sorted(map(tuple, io.load_table(spark, f"{tmp_path}/t.{ext}").select("a", "b").collect())) == [(1, "x"), (2, "y")]
        assert io.load_table(spark, f"{tmp_path}/t.{ext}", max_rows=1).count() == 1
    with pytest.raises(io.UnsupportedFormat):
        io.load_table(spark, f"{tmp_path}/t.xlsx")
