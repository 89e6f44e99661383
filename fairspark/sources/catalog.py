"""Named datasets: declared schemas, roles, and scans by name, path or extension."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(ddl: str) -> T.StructType:
    """``name type`` pairs as a StructType, without a running session."""
    kinds = {"int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "timestamp": T.TimestampType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (part.split() for part in ddl.split(","))])


@dataclass(frozen=True)
class Dataset:
    filename: str
    schema: T.StructType
    target: str
    sensitive: tuple[str, ...]
    description: str = ""

    def typed(self) -> T.StructType:
        """The schema with each column's role in its metadata."""
        role = lambda n: "target" if n == self.target else "sensitive" if n in self.sensitive else "feature"
        return T.StructType([T.StructField(f.name, f.dataType, f.nullable, {"role": role(f.name)}) for f in self.schema])


ADULT = _schema(
    "age int,workclass string,fnlwgt int,education string,education_num int,marital_status string,occupation string,"
    "relationship string,race string,sex string,capital_gain int,capital_loss int,hours_per_week int,native_country string,income string"
)
COMPAS = _schema(
    "age int,c_charge_degree string,race string,age_cat string,score_text string,sex string,priors_count int,"
    "days_b_screening_arrest int,decile_score int,is_recid int,two_year_recid int,c_jail_in timestamp,c_jail_out timestamp"
)
GERMAN_NUMERIC = {2, 5, 8, 11, 13, 16, 18}
GERMAN = _schema(
    ",".join(f"Attribute{i} {'int' if i in GERMAN_NUMERIC else 'string'}" for i in range(1, 21)) + ",class int"
)
# The shape of the warehouse tables used by the registered queries.
CUSTOMER = _schema("c_custkey bigint,c_name string,c_nationkey int,c_acctbal double,c_mktsegment string")


@dataclass
class Catalog:
    """Registry of datasets below one folder (any Hadoop path)."""

    root: str
    datasets: dict[str, Dataset] = field(default_factory=dict)

    def register(self, name: str, dataset: Dataset) -> Catalog:
        self.datasets[name] = dataset
        return self

    def get(self, name: str) -> Dataset:
        if name not in self.datasets:
            raise KeyError(f"unknown dataset {name!r}; available: {', '.join(sorted(self.datasets))}")
        return self.datasets[name]

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        """Scan a registered CSV with its declared schema (no inference pass)."""
        d = self.get(name)
        raw = spark.read.schema(d.schema).option("header", True).csv(f"{self.root.rstrip('/')}/{d.filename}")
        return raw.to(d.typed())

    def listing(self, spark: SparkSession) -> DataFrame:
        """One row per dataset with its counts and roles; the counts run as one plan."""
        parts = [
            self.load(spark, n).agg(F.count("*").alias("n_rows")).select(
                F.lit(n).alias("name"), "n_rows", F.lit(len(d.schema)).alias("n_columns"), F.lit(d.target).alias("target"),
                F.lit(",".join(d.sensitive)).alias("sensitive"),
            )
            for n, d in self.datasets.items()
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def default_catalog(root: str) -> Catalog:
    """The three bundled dataset descriptions."""
    cat = Catalog(root)
    cat.register("adult_census", Dataset("adult_census.csv", ADULT, "income", ("sex", "race"), "Income above a bound"))
    cat.register("compas", Dataset("compas.csv", COMPAS, "is_recid", ("race", "sex"), "Recidivism scores"))
    cat.register("german_credit", Dataset("german_credit.csv", GERMAN, "class", ("Attribute9", "Attribute10"), "Credit risk"))
    return cat


def load_custom(spark: SparkSession, path: str) -> DataFrame:
    """A user's CSV with header; types are inferred (an extra pass, so name a schema at scale)."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def load_file(spark: SparkSession, path: str, schema: T.StructType | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Scan by extension: csv, tsv, json or parquet."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    reader = spark.read.option("encoding", encoding)
    reader = reader.schema(schema) if schema is not None else reader
    if kind == "json":
        return reader.json(path)
    if kind in ("csv", "tsv"):
        reader = reader.option("header", True).option("sep", "\t" if kind == "tsv" else ",")
        return (reader if schema is not None else reader.option("inferSchema", True)).csv(path)
    raise ValueError(f"unsupported file type {kind!r}; use csv, tsv, json or parquet")


def load_trimmed(spark: SparkSession, path: str, schema: T.StructType, null_token: str = "?", header: bool = False) -> DataFrame:
    """Raw delimited files with blanks around values and a token for missing ones."""
    reader = spark.read.schema(schema).option("header", header).option("ignoreLeadingWhiteSpace", True)
    return reader.option("ignoreTrailingWhiteSpace", True).option("nullValue", null_token).csv(path)


def clean_tokens(df: DataFrame, token: str = "?", subset: Sequence[str] | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Missing-value token to null, rows with a null (in the subset) dropped, listed columns kept."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    out = df.replace(token, None, subset=text) if text else df
    out = out.dropna(how="any", subset=list(subset) if subset else None)
    return out.select(*[c for c in keep if c in df.columns]) if keep else out
