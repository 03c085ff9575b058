"""Stand-ins for imagery, captures and areas, made of the test tables. They exercise arithmetic and relations, not imagery.

Each is SQL that Spark and DuckDB read alike, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

PIXELS = """
select cast(case when l_suppkey % 24 = 3 then l_suppkey + 1 else l_suppkey end as int) as aoi_id, cast(l_orderkey % 5 as int) as photo_id, l_orderkey * 10 + l_linenumber as px,
  cast(case when l_orderkey % 97 = 0 then 65535 when l_orderkey % 89 = 0 then 0 else (l_partkey * 7 + l_linenumber * 131) % 3000 end as int) as d1,
  cast(case when l_orderkey % 89 = 0 then 0 else (l_partkey * 13 + l_linenumber * 173) % 5000 end as int) as d2,
  cast(case when l_orderkey % 89 = 0 then 0 else (l_suppkey * 29 + l_orderkey * 3) % 6000 end as int) as d3,
  cast(case when l_orderkey % 89 = 0 then 0 else (l_partkey * 17 + l_orderkey * 5) % 12000 end as int) as d4,
  cast(case when l_orderkey % 89 = 0 then 0 else (l_partkey * 19 + l_orderkey * 11) % 20000 end as int) as d5
from lineitem
"""
CAPTURES = """
select event_id as cap_id, cast(500000 as double) + (user_id * 37 + event_id * 13) % 1000 as cx,
  cast(4470000 as double) + (user_id * 53 + event_id * 7) % 1000 as cy,
  cast((event_id % 40) - 5 as double) as altitude, radians(cast(event_id % 360 as double)) as yaw,
  (event_id % 7) * cast(0.01 as double) as roll, (event_id % 5) * cast(0.01 as double) as pitch
from events
"""
#: Some areas have no pixels: those whose number leaves 3 divided by 24.
AREAS = """
select cast(s_suppkey as int) as aoi_id, cast(500000 as double) + (s_suppkey * 41) % 1000 as ax, cast(4470000 as double) + (s_suppkey * 67) % 1000 as ay
from supplier
"""
#: Five-sided plots around the areas' centres.
POLYGONS = f"""
select aoi_id, ax, ay, ax - 18 as x1, ay - 14 as y1, ax + 16 as x2, ay - 18 as y2, ax + 18 as x3, ay + 9 as y3, ax + 2 as x4, ay + 17 as y4, ax - 15 as x5, ay + 12 as y5
from ({AREAS}) a
"""
#: Pixels on a one-metre grid around captures.
GRID = """
select cast(500000 as double) + (o_orderkey * 7) % 1000 + cast(0.5 as double) as x, cast(4470000 as double) + (o_custkey * 13 + o_orderkey * 3) % 1000 + cast(0.5 as double) as y, o_orderkey as px
from orders
"""
LABELS = """
select event_id as id, case when event_id % 11 = 0 then 'bad' when event_id % 13 = 0 then 'AOI_x' else concat('AOI_', cast(event_id % 24 as varchar), '_ratio_0.05') end as label from events
"""
IMAGES = """
select event_id as id, concat('Images/set', cast(user_id % 3 as varchar), '/IMG_', cast(event_id as varchar), '_', cast(event_id % 5 + 1 as varchar), '.tif') as path,
  cast(floor(event_id / cast(5 as double)) as bigint) as capture from events
"""
VIEWS = {"pixels": PIXELS, "captures": CAPTURES, "areas": AREAS, "polygons": POLYGONS, "grid": GRID, "chunk_labels": LABELS, "images": IMAGES}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in as a DataFrame; tables are read where the SQL names them, so no view is left behind."""
    sql = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in re.findall(r"\b(lineitem|events|supplier|orders|embeddings|customer|part)\b", sql)}
    for t in tables:
        sql = re.sub(rf"\bfrom {t}\b", f"from {{{t}}}", sql)
    sql = re.sub(r"cast\(([^()]*(?:\([^()]*\))?[^()]*) as varchar\)", r"cast(\1 as string)", sql)
    return spark.sql(sql, **tables)


def with_views(body: str, *names: str) -> str:
    """DuckDB SQL with the named stand-ins as common table expressions."""
    return "with " + ", ".join(f"{n} as ({VIEWS[n]})" for n in names) + body
