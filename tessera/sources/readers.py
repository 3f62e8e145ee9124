"""Scans of the source layouts: text tables with guarded schemas, and landed API responses.

Every reader takes paths that Spark can list and read; downloads land their files first. Keys are read as strings, so that
leading zeros survive; schemas are given, so that no inference pass runs and Spark prunes columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.semantics import floored_log10, numeric, zfill
from tessera.sources.zipped import FILE, zipped_table


def text_table(spark: SparkSession, path: str | list[str], columns: Sequence[str] = (), sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """All columns as strings, header names stripped; ValueError naming required columns that are absent."""
    df = spark.read.csv(path, sep=sep, header=True, encoding=encoding, inferSchema=False)
    df = df.toDF(*[c.strip() for c in df.columns])
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns {missing} are missing from {path}")
    return df


def crosswalk(spark: SparkSession, path: str, states: dict[str, str]) -> DataFrame:
    """(county_name, fips_code) from a tab-separated gazetteer; territories without a state name are left out."""
    columns = ["USPS", "GEOID", "NAME"]
    df = zipped_table(spark, path, columns, sep="\t") if path.endswith(".zip") else text_table(spark, path, columns, sep="\t")
    names = F.create_map(*[F.lit(x) for kv in states.items() for x in kv])
    suffixed = F.regexp_replace("NAME", " city$", " City")
    return df.where(F.element_at(names, F.col("USPS")).isNotNull()).select(F.concat(suffixed, F.lit(", "), names[F.col("USPS")]).alias("county_name"), zfill("GEOID", 5).alias("fips_code"))


def centroids(spark: SparkSession, path: str) -> DataFrame:
    columns = ["GEOID", "INTPTLAT", "INTPTLONG"]
    df = zipped_table(spark, path, columns, sep="\t", encoding="latin-1") if path.endswith(".zip") else text_table(spark, path, columns, sep="\t", encoding="ISO-8859-1")
    return df.select(zfill("GEOID", 5).alias("fips_code"), numeric("INTPTLAT").alias("lat"), numeric(F.trim("INTPTLONG")).alias("lon"))


#: Columns of the county sectors that are read.
SECTOR_COLUMNS = ["area_fips", "industry_code", "agglvl_code", "own_code", "qtr", "disclosure_code"]


def county_sectors(spark: SparkSession, path: str, more: Sequence[str] = ()) -> DataFrame:
    """Fourth-quarter private rows by sector, and the totals; the filter is pushed into the scan. A zip file is inflated as a stream
    and filtered inside its reader. ValueError where nothing is left."""
    columns = [*SECTOR_COLUMNS, *more]
    if path.endswith(".zip"):
        df = zipped_table(spark, path, columns, "*.csv", only={"qtr": ["4"], "own_code": ["5"], "agglvl_code": ["71", "74"]})
    else:
        df = text_table(spark, path, columns)
    kept = df.where("qtr = '4' AND own_code = '5' AND (agglvl_code = '74' OR (agglvl_code = '71' AND industry_code = '10'))")
    if kept.limit(1).count() == 0:
        raise ValueError(f"no county sector rows in {path}")
    return kept


#: The tables of a state's zip file of flows, by member.
FLOW_TABLES = {"county_to_county": "1.County-to-County.csv", "county_to_zone": "2.County-to-FAF.csv", "zone_to_county": "2.FAF-to-County.csv"}


def zipped_flows(spark: SparkSession, path: str, columns: dict[str, Sequence[str]]) -> dict[str, DataFrame]:
    """By table the domestic rows of all states' zip files in a folder: the given columns, tons_2022 as a number, and the state, which
    is the file's name. A state without one of the tables is a ValueError."""
    state = F.regexp_extract(FILE, r"([^/]+)\.zip$", 1)
    return {
        name: zipped_table(spark, path, [*columns[name], "tons_2022", "trade_type", FILE], member, only={"trade_type": ["1"]}).select(state.alias("state"), *columns[name], numeric("tons_2022").alias("tons_2022"))
        for name, member in FLOW_TABLES.items()
        if name in columns
    }


def state_flows(spark: SparkSession, path: str) -> DataFrame:
    """Origin-destination rows of all states' files, the state from the folder name state=XX; domestic trade only."""
    df = text_table(spark, path, ["tons_2022", "trade_type"])
    return df.withColumns({"tons_2022": numeric("tons_2022"), "trade_type": F.col("trade_type").try_cast("int")}).where("trade_type = 1")


def annual_panel(spark: SparkSession, paths: dict[int, str], columns: dict[str, str]) -> DataFrame:
    """One row a county and year: keys padded before state totals ('000') go, codes renamed and made numbers."""
    out = None
    for year, path in sorted(paths.items()):
        df = text_table(spark, path, ["STATEFIPS", "COUNTYFIPS", *columns], encoding="ISO-8859-1")
        df = df.withColumn("_c", zfill("COUNTYFIPS", 3)).where("_c <> '000'")
        part = df.select(F.concat(zfill("STATEFIPS", 2), "_c").alias("fips_code"), F.lit(year).alias("tax_year"), *[numeric(c).alias(n) for c, n in columns.items()])
        out = part if out is None else out.unionByName(part)
    return out


def attributes(spark: SparkSession, path: str) -> DataFrame:
    df = text_table(spark, path, ["FIPStxt", "Attribute", "Value"])
    return df.withColumns({"FIPStxt": zfill("FIPStxt", 5), "Value": numeric("Value")})


#: First years of the summary-file layout that can be read.
FIRST_SUMMARY_YEAR = 2021


def summary_file(spark: SparkSession, path: str, year: int) -> DataFrame:
    """Pipe-delimited estimates of counties: key without its prefix, null tokens and text to null."""
    if year < FIRST_SUMMARY_YEAR:
        raise ValueError(f"the table-based layout begins in {FIRST_SUMMARY_YEAR}")
    df = text_table(spark, path, ["GEO_ID"], sep="|").where(F.col("GEO_ID").startswith("0500000US"))
    value = lambda c: numeric(F.when(~F.trim(c).isin("", ".", "-", "null"), F.trim(c)))
    return df.select(F.substring("GEO_ID", 10, 5).alias("fips_code"), *[value(c).alias(c) for c in df.columns if c != "GEO_ID"])


def observations(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, year, value) of landed responses, one JSON object a line; '.' is no observation."""
    df = spark.read.schema("series_id string, observations array<struct<date:string,value:string>>").json(path)
    rows = df.select("series_id", F.explode("observations").alias("o")).where("o.value <> '.'")
    return rows.select("series_id", F.substring("o.date", 1, 4).cast("int").alias("year"), numeric("o.value").alias("value"))


def population(spark: SparkSession, path: str, column: str = "POPESTIMATE2024") -> DataFrame:
    """(fips_code, population, size) of counties."""
    df = text_table(spark, path, ["SUMLEV", "STATE", "COUNTY", column], encoding="ISO-8859-1").where("cast(SUMLEV as int) = 50")
    n = numeric(column)
    return df.select(F.concat(zfill("STATE", 2), zfill("COUNTY", 3)).alias("fips_code"), n.alias("population"), floored_log10(n).alias("size"))


def artifact(spark: SparkSession, path: str, schema: str, texts: Sequence[str] = ()) -> DataFrame:
    """A result table that was written as CSV or as JSON lines. CSV knows no empty strings: in the columns named in texts a missing one is empty again."""
    df = spark.read.schema(schema).json(path) if path.endswith((".json", ".jsonl")) else spark.read.schema(schema).csv(path, header=True)
    return df.withColumns({c: F.coalesce(c, F.lit("")) for c in texts})


def panel(keys: DataFrame, blocks: Sequence[DataFrame], places: DataFrame, key: str, needed: Sequence[str]) -> DataFrame:
    """keys joined with each block (rows without one go) and with places (rows stay); ValueError where a row then lacks a needed column."""
    for b in blocks:
        keys = keys.join(b, key)
    out = keys.join(places, key, "left")
    gaps = out.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in needed]).first().asDict() if needed else {}
    if any(gaps.values()):
        raise ValueError(f"rows without {', '.join(c for c, n in gaps.items() if n)}")
    return out


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, built and written first where it is absent; Spark's success marker decides, so half-written folders count as absent."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
