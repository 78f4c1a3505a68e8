"""Domain tables derived from the supplied parquet tables.

Each table is a chain of projections in SQL that Spark and DuckDB read alike, so a query and its
SQL twin start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vestigo.operators.spread import settle

# A line is identified by order, line number, part and supplier together.
_LINE_ID = "(CAST(l_linenumber AS BIGINT)*10000000+l_partkey)*100000+l_suppkey"
_CONF = "1-l_discount*10"
_BOX = [
    "l_quantity*10 AS x1",
    "l_tax*1000 AS y1",
    "l_quantity*10+80+l_suppkey%40 AS x2",
    "l_tax*1000+20+l_partkey%20 AS y2",
]
_ENGINE = "'engine_' || lower(l_returnflag)"
_PLATE = (
    "chr(CAST(65+seed%26 AS INT)) || chr(CAST(65+CAST(floor(seed/26.0) AS BIGINT)%26 AS INT)) || "
    "chr(CAST(65+(seed*3)%26 AS INT)) || CASE WHEN seed%11=0 THEN lpad(CAST(seed%100 AS STRING),2,'0') "
    "WHEN seed%3=0 THEN CAST(seed%10 AS STRING) || chr(CAST(65+seed%23 AS INT)) || "
    "lpad(CAST(seed%97 AS STRING),2,'0') ELSE lpad(CAST(seed%10000 AS STRING),4,'0') END"
)

TABLES: dict[str, tuple[str, list[list[str]]]] = {
    "detections": (
        "lineitem",
        [
            [
                "l_orderkey AS evidence_id",
                f"{_LINE_ID} AS det_id",
                *_BOX,
                f"{_CONF} AS confidence",
                "CASE WHEN l_linestatus='O' THEN 'primary' ELSE 'secondary' END AS source",
            ]
        ],
    ),
    "reads": (
        "lineitem",
        [
            [
                "l_orderkey",
                f"{_LINE_ID} AS read_id",
                "l_linenumber",
                "l_partkey",
                "l_suppkey",
                f"{_ENGINE} AS engine",
                f"CASE WHEN l_suppkey%3=0 THEN ({_CONF})*100 ELSE {_CONF} END AS confidence",
                *_BOX,
                "l_orderkey*7 + CASE WHEN l_suppkey%4=0 THEN l_partkey%3 ELSE 0 END AS seed",
            ],
            [
                "l_orderkey AS evidence_id",
                "read_id",
                "CAST(l_linenumber AS BIGINT) AS det_rank",
                "engine",
                "confidence",
                f"CASE WHEN l_partkey%9=0 THEN lower({_PLATE}) WHEN l_partkey%9=1 THEN "
                f"substr({_PLATE},1,3) || '-' || substr({_PLATE},4,4) WHEN l_partkey%13=0 THEN '' "
                f"ELSE {_PLATE} END AS text",
                "CASE WHEN l_suppkey%7=3 THEN NULL ELSE x1 END AS x1",
                "CASE WHEN l_suppkey%7=3 THEN NULL ELSE y1 END AS y1",
                "CASE WHEN l_suppkey%7=3 THEN NULL ELSE x2 END AS x2",
                "CASE WHEN l_suppkey%7=3 THEN NULL ELSE y2 END AS y2",
            ],
        ],
    ),
    "engine_runs": (
        "orders",
        [
            [
                "o_orderkey AS evidence_id",
                "CASE WHEN o_custkey%3=0 THEN 'engine_a' WHEN o_custkey%3=1 THEN 'engine_n' ELSE '' END "
                "AS selected_engine",
                "o_orderstatus='P' AS disabled",
                "CASE WHEN o_orderpriority='1-URGENT' THEN 'timeout' ELSE '' END AS error",
            ]
        ],
    ),
    "image_scores": (
        "orders",
        [["o_orderkey AS evidence_id", "CAST(o_custkey%100 AS DOUBLE)/100 AS quality"]],
    ),
    "frames": (
        "events",
        [
            [
                "user_id AS video_id",
                "event_id AS frame_index",
                "ts",
                "value AS sharpness",
                "value AS confidence",
                "CASE WHEN event_type='error' THEN '' ELSE upper(substr(event_type,1,3)) || "
                "lpad(CAST(user_id%100 AS STRING),4,'0') END AS ocr",
                "event_type",
                "props",
            ]
        ],
    ),
    "vehicle_ref": (
        "part",
        [
            [
                "p_partkey AS ref_id",
                "p_brand AS make",
                "p_name AS model",
                "1990+p_size AS year",
                "p_type AS variant",
            ]
        ],
    ),
    "spans": (
        "lineitem",
        [
            [
                "l_orderkey AS analysis_id",
                "'stage_' || CAST(l_linenumber AS STRING) AS stage",
                "l_extendedprice/100 AS duration_ms",
                "CASE WHEN l_returnflag='R' THEN 'error' ELSE 'ok' END AS status",
                "l_shipdate AS started_at",
            ]
        ],
    ),
    "bench_samples": (
        "orders",
        [
            [
                "o_orderkey AS sample_id",
                "o_orderpriority AS scenario",
                "o_orderstatus AS config",
                "o_orderkey%3<>0 AS matched",
                "1+o_custkey%5 AS expected_rank",
                "o_totalprice/1000 AS weighted_support",
                "o_custkey",
                "o_orderdate",
                "o_totalprice",
            ]
        ],
    ),
    "provider_records": (
        "lineitem",
        [
            [
                "l_partkey AS plate_id",
                "l_suppkey AS source_id",
                "l_returnflag AS cor",
                "l_linestatus AS uf",
                "CAST(l_linenumber AS STRING) AS ano",
                "l_shipdate AS received_at",
            ]
        ],
    ),
}


# Reads of a worn plate: every letter comes out as one that is easily confused.
_READS = TABLES["reads"]
TABLES["misreads"] = (
    _READS[0],
    [
        *_READS[1],
        [
            "evidence_id",
            "read_id",
            "translate(upper(text), 'ABCDEFGHJKMNPQRTUVWXY', 'ILILILILILILILILILILI') AS text",
        ],
    ],
)


# Columns that are a long derivation, settled once on loading.
_BUILT = {
    "reads": ["text"],
    "misreads": ["text"],
    "config_rows": ["expected", "observed"],
    "engine_results": ["w1", "w2", "text", "c1", "c2"],
    "short_candidates": ["text"],
}


def add(name: str, base: str, *stages: list[str]) -> None:
    """Define one more domain table."""
    TABLES[name] = (base, list(stages))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Tables whose derivation costs far more than moving the raw rows.
_COSTLY = {*_BUILT, "provider_answers"}


def _over_all_cores(df: DataFrame) -> DataFrame:
    """Spread a table that comes as fewer splits than there are cores (one small file, in tests); a
    large table already has more splits than that and is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, stages = TABLES[name]
    df = read(spark, sf_dir, base)
    if name in _COSTLY:
        df = _over_all_cores(df)
    for stage in stages:
        df = df.selectExpr(*stage)
    built = _BUILT.get(name)
    if built:
        df = settle(df, *built)
    return df


def sql_of(name: str) -> str:
    base, stages = TABLES[name]
    text = base
    for stage in stages:
        text = f"(SELECT {', '.join(stage)} FROM {text}) AS _{name}"
    return f"SELECT * FROM {text}"


def with_tables(*names: str, recursive: bool = False) -> str:
    """Opening WITH clause that defines the named domain tables."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ", ".join(f"{n} AS ({sql_of(n)})" for n in names)
