"""The heritage registry: paged lists and details as recorded XML, and the nodes and edges they make."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import expr

# Codes of designations and of regions, and the fields of lists and details.
KINDS = {"11": "국보", "12": "보물", "13": "사적", "15": "명승", "16": "천연기념물", "17": "국가무형유산", "18": "국가민속문화유산", "21": "시도유형문화유산", "22": "시도무형유산", "23": "시도기념물", "24": "시도민속문화유산", "31": "문화유산자료", "79": "등록문화유산"}
REGIONS = {"11": "서울특별시", "21": "부산광역시", "22": "인천광역시", "23": "대구광역시", "24": "광주광역시", "25": "대전광역시", "26": "울산광역시", "45": "세종특별자치시", "31": "경기도", "32": "강원특별자치도", "33": "충청북도", "34": "충청남도", "35": "전북특별자치도", "36": "전라남도", "37": "경상북도", "38": "경상남도", "50": "제주특별자치도"}
LIST_FIELDS = ["ccbaAsno", "ccbaMnm1", "ccbaMnm2", "longitude", "latitude", "ccbaCtcdNm", "ccsiName", "ccmaName", "ccbaAdmin"]
DETAIL_FIELDS = ["content", "ccbaAsdt", "ccbaQuan", "ccbaLcad", "gcodeName", "bcodeName", "mcodeName", "scodeName", "imageUrl", "ccceName"]
DETAIL_PAGE = "https://www.heritage.go.kr/heri/cul/culSelectDetail.do"

SOURCE = "khs"
PAGES = "kdcd string, ctcd string, page int, text string"


def _schema(fields: list[str]) -> str:
    return f"totalCnt string, item array<struct<{','.join(f'{f}:string' for f in fields)}>>, _bad string"


def _parsed(text: Column, fields: list[str]) -> Column:
    return F.from_xml(text, _schema(fields), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})


def _texts(item: Column, fields: list[str]) -> list[Column]:
    return [F.nullif(expr.strip(item[f]), F.lit("")).alias(f) for f in fields]


def listed(pages: DataFrame, page_size: int = 100) -> DataFrame:
    """``kdcd, ctcd`` and the fields of every item that a reader of the pages (PAGES) would have met.

    A list is read from page 1 until a page is missing, broken or empty, or until pages of ``page_size`` cover the total that
    it names. Of repeated pages one counts.
    """
    key = ["kdcd", "ctcd", "page"]
    read = pages.groupBy(*key).agg(F.max("text").alias("text")).withColumn("x", _parsed(F.col("text"), LIST_FIELDS))
    bad = F.col("x").isNull() | F.col("x._bad").isNotNull() | (F.coalesce(F.size("x.item"), F.lit(0)) <= 0)
    total = F.coalesce(F.col("x.totalCnt").try_cast("long"), F.lit(0))
    marked = read.select(*key, bad.alias("bad"), (bad | (F.col("page") * page_size >= total)).alias("last"))
    # The first page that ends its list, or that no page comes before.
    flat = marked.select("kdcd", "ctcd", "page", "bad", "last", F.expr("row_number() over (partition by kdcd, ctcd order by page)").alias("nth"))
    ends = flat.groupBy("kdcd", "ctcd").agg(F.expr("min(page) filter (where last)").alias("end"), F.expr("min(page) filter (where page <> nth)").alias("gap"))
    whole = read.join(ends, ["kdcd", "ctcd"]).where(~bad & (F.col("page") <= F.coalesce("end", F.col("page"))) & (F.col("page") < F.coalesce("gap", F.col("page") + 1)))
    return whole.select("kdcd", "ctcd", F.explode("x.item").alias("i")).select("kdcd", "ctcd", *_texts(F.col("i"), LIST_FIELDS))


def details(payloads: DataFrame) -> DataFrame:
    """``kdcd, ctcd, ccbaAsno`` and the fields of details (with ``text``); broken ones, and those without an item, give no row."""
    x = payloads.select("kdcd", "ctcd", "ccbaAsno", _parsed(F.col("text"), DETAIL_FIELDS).alias("x")).where("x._bad is null and size(x.item) > 0")
    return x.select("kdcd", "ctcd", "ccbaAsno", *_texts(F.col("x.item")[0], DETAIL_FIELDS)).dropDuplicates(["kdcd", "ctcd", "ccbaAsno"])


def ingest(items: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and aliases (node_id, alias) of listed items and their details.

    Items without a number or a name are left out, those without details have what the list says. A place is a node for each
    province and district, with both in its props; the region's code stands in for a missing province.
    """
    own = items.where("ccbaAsno is not null and ccbaMnm1 is not null").dropDuplicates(["kdcd", "ctcd", "ccbaAsno"]).join(found, ["kdcd", "ctcd", "ccbaAsno"], "left")
    named = {name: F.create_map(*(F.lit(x) for kv in values.items() for x in kv)) for name, values in (("kind", KINDS), ("region", REGIONS))}
    own = own.withColumns({"id": F.concat(F.lit(f"{SOURCE}:"), F.concat_ws("-", "kdcd", "ctcd", "ccbaAsno")), "sido": F.coalesce("ccbaCtcdNm", named["region"][F.col("ctcd")])})
    own = own.withColumns({"place": F.concat(F.lit("kr:place:"), F.concat_ws(":", "sido", "ccsiName")), "period": F.concat(F.lit("kr:period:"), "ccceName")})
    props = F.to_json(
        F.struct(
            F.coalesce("ccmaName", named["kind"][F.col("kdcd")]).alias("designation"), expr.designated_date(F.col("ccbaAsdt")).alias("designated_on"), F.col("ccbaQuan").alias("quantity"), F.col("ccbaLcad").alias("address"), F.col("ccbaAdmin").alias("admin"),
            F.array_compact(F.array("gcodeName", "bcodeName", "mcodeName", "scodeName")).alias("category"), F.col("imageUrl").alias("image"), "kdcd", "ctcd", F.col("ccbaAsno").alias("asno"),
        ),
        {"ignoreNullFields": "false"},
    )
    url = F.concat(F.lit(f"{DETAIL_PAGE}?ccbaKdcd="), "kdcd", F.lit("&ccbaAsno="), "ccbaAsno", F.lit("&ccbaCtcd="), "ctcd")
    none, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    nodes = own.select("id", F.lit("heritage").alias("type"), F.col("ccbaMnm1").alias("label"), F.lit(SOURCE).alias("source"), F.col("content").alias("description"), expr.to_double(F.col("latitude")).alias("lat"), expr.to_double(F.col("longitude")).alias("lon"), url.alias("url"), props.alias("props"))
    place = F.to_json(F.struct("sido", F.col("ccsiName").alias("sigungu")), {"ignoreNullFields": "false"})
    places = own.where("sido is not null").select(F.col("place"), F.lit("place"), F.concat_ws(" ", "sido", "ccsiName"), F.lit(SOURCE), none, number, number, none, place).distinct()
    periods = own.where("period is not null").select("period", F.lit("period"), "ccceName", F.lit(SOURCE), none, number, number, none, F.lit("{}")).distinct()
    edges = own.where("sido is not null").select(F.col("id").alias("src"), F.col("place").alias("dst"), F.lit("located_in").alias("type"), F.lit(SOURCE).alias("source"))
    edges = edges.union(own.where("period is not null").select("id", "period", F.lit("from_period"), F.lit(SOURCE)))
    other = own.where("ccbaMnm2 is not null and ccbaMnm2 <> ccbaMnm1").select(F.col("id").alias("node_id"), F.col("ccbaMnm2").alias("alias"))
    return nodes.union(places).union(periods), edges, other


class _List(InputPartition):
    def __init__(self, kdcd: str, ctcd: str) -> None:
        super().__init__((kdcd, ctcd))


def paged_list(fetch: Callable[[str, str, int], str], name: str = "heritage_list") -> type[DataSource]:
    """A data source of list pages (PAGES) to be registered: one partition for every kind and region, each read page by page.

    ``fetch(kdcd, ctcd, page)`` is the caller's client; what it raises fails the task, which Spark tries again. Options: ``kinds``
    and ``regions``, codes with commas between (by default the first kind and all regions), and ``pageSize``.
    """

    class Reader(DataSourceReader):
        def __init__(self, kinds: str, regions: str, size: str) -> None:
            self.kinds, self.regions, self.size = kinds.split(","), regions.split(","), int(size)

        def partitions(self) -> list[_List]:
            return [_List(*x) for x in product(self.kinds, self.regions)]

        def read(self, partition: _List) -> Iterator[tuple]:
            kdcd, ctcd = partition.value
            page, more = 1, True
            while more:
                text = fetch(kdcd, ctcd, page)
                yield kdcd, ctcd, page, text
                total = re.search(r"<totalCnt>\s*(\d+)\s*</totalCnt>", text)
                more = "<item>" in text and total is not None and page * self.size < int(total[1])
                page += 1

    class PagedList(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return PAGES

        def reader(self, schema: object) -> DataSourceReader:
            o = self.options
            return Reader(o.get("kinds", next(iter(KINDS))), o.get("regions", ",".join(REGIONS)), o.get("pageSize", "100"))

    return PagedList
