"""Splitting contents into overlapping parts, numbering and tagging them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import running

#: Separators of the recursive splitter, coarse to fine.
SEPARATORS = ("\n\n", "\n", "。", "；", "，", " ", "")


def split_recursively(text: str, size: int = 800, overlap: int = 150, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Parts of at most `size` characters: split at the first separator that occurs, which stays at the start of the
    next piece; longer pieces are split again by the finer ones; small neighbours are joined up to the size, and each
    part begins with the last pieces of the one before, up to the overlap."""
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    mark, finer = separators[at], separators[at + 1 :]
    if mark == "":
        found = list(text)
    else:
        head, *rest = text.split(mark)
        found = [x for x in (head, *(mark + r for r in rest)) if x]
    out: list[str] = []
    small: list[str] = []

    def join() -> None:
        window: list[str] = []
        total = 0
        for piece in small:
            if total + len(piece) > size and window:
                out.append("".join(window).strip())
                while total > overlap or (total + len(piece) > size and total > 0):
                    total -= len(window.pop(0))
            window.append(piece)
            total += len(piece)
        if window:
            out.append("".join(window).strip())
        small.clear()

    for piece in found:
        if len(piece) < size:
            small.append(piece)
        else:
            join()
            out.extend(split_recursively(piece, size, overlap, finer) if finer else [piece])
    join()
    return [x for x in out if x]


def parts(df: DataFrame, text: str = "content", size: int = 800, overlap: int = 150) -> DataFrame:
    """Adds part and part_text: texts of at most `size` stay whole, longer ones are split recursively."""

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else split_recursively(t, size, overlap))

    whole = df.filter(F.length(text) <= size).withColumn("part", F.lit(0)).withColumn("part_text", F.col(text))
    long = df.filter(F.length(text) > size).withColumn("_p", cut(F.col(text))).select("*", F.posexplode("_p").alias("part", "part_text")).drop("_p")
    return whole.unionByName(long)


def numbered(df: DataFrame, section: str, order: list[str]) -> DataFrame:
    """Adds chunk_index from 0 and chunk_count within each section, of any size."""
    rows = running(df.withColumn("_one", F.lit(1)), [section], order, sums=("_one",))
    return rows.join(df.groupBy(section).agg(F.count("*").alias("chunk_count")), section).withColumn("chunk_index", F.col("sum__one") - 1).drop("_one", "sum__one")


def unique_id(base: Column, index: Column, count: Column) -> Column:
    return F.when(count > 1, F.concat(base, F.lit("_p"), index)).otherwise(base)


def with_header(text: Column, header: Column) -> Column:
    return F.when(text.startswith(header), text).otherwise(F.concat(header, text))


# Families of topics in the order tried, the terms of each, and those looked for where a topic gives too few.
TOPICS = (
    ("地理概况", "东经|北纬|东西长|南北宽|总面积|km2|地处|地形|地貌|海拔|DEM|土地覆盖|土地利用|平原|丘陵|盆地|山区|位于.*边陲|欧亚大陆"),
    ("品种资源", r"品种|新冬\p{Nd}+|九圣|金石农|石冬|新粮|主栽品种|示范品种|中强筋|超高产品种|品种类型"),
    ("越冬条件", "越冬|积雪|冻害|安全越冬|积雪深度|越冬期|极端最低气温|冻不坏|抗寒|耐寒"),
    ("区划指标", "区划因子|区划指标|分级标准|分级阈值|适宜区|次适宜|不适宜|适宜性|指标体系|等级划分|阈值|区划指数|种植区划|最适宜|不可种植"),
    ("方法与算法", "公式|回归|统计方法|权重|模型|数据来源|数据处理|普查|气象观测站|多元回归|层次分析|AHP|GIS|归一化|标准化|指数|计算.*方法"),
    ("灾害风险", "风险区划|灾害|渍涝|干旱|冷害|霜冻|病虫害|条锈病|赤霉病|蚜虫|干热风|风险指数|风险等级|致灾因子|承灾体|防灾减灾|孕灾环境"),
    ("气象要素", "气温|降水量|积温|日照|辐射|蒸发|风速|相对湿度|平均气温|活动积温|有效积温|无霜期|生长季|年降水"),
    ("生育期", "生育期|发育期|物候|播种|出苗|开花|成熟|鼓粒|黄熟|拔节|抽穗|灌浆|发育阶段|生长期|生物学下限"),
    ("品质评价", "品质|蛋白质|湿面筋|容重|稳定时间|品质指标|品质区划|品质评分|中强筋|强筋|弱筋"),
    ("产量分级", "产量|光温生产潜力|单产|公斤|产量区划|产量分级|产量等级|生产力"),
)
UNTOLD = "(未分类)"
ENTITIES = (
    ("地理概况", "东经|北纬|经度|纬度|海拔|DEM|数字高程|平原|丘陵|盆地|山区|高原|土地覆盖|土地利用|地貌|欧亚大陆|西北边陲"),
    ("品种资源", r"新冬\p{Nd}+号?|九圣[\p{L}\p{N}_]+|金石农\p{Nd}+号?|石冬\p{Nd}+号?|新粮\p{Nd}+号?|石冬\p{Nd}+号?"),
    ("越冬条件", "越冬期|安全越冬|积雪深度|积雪覆盖|极端最低气温|越冬条件|冻害|抗寒性|越冬死亡率|返青率"),
    ("区划指标", "活动积温|有效积温|稳定≥?10℃.*?积温|≥?10℃.*?积温|5～?9\\s*月.*?降水|生长季.*?降水|年降水量|平均气温|极端最低气温|最高气温|最低气温|最适宜区|适宜区|次适宜区|不适宜区|日照时数|太阳辐射|光合有效辐射|无霜期|≥0℃积温|活动积温|土壤质地|土壤类型|坡度|坡向"),
    ("方法与算法", "AHP|GIS|ET0|NDVI|DEM|层次分析[法]?|多元回归|逐步回归|归一化|标准化|加权求和|主成分分析|聚类分析|模糊数学|专家打分|Penman.*?公式|FAO.*?公式|Thornthwaite|Hargreaves|作物系数|Kc|克里金插值|反距离权重|空间插值"),
    ("灾害风险", "干旱|渍涝|冷害|霜冻|冻害|冰雹|大风|干热风|条锈病|赤霉病|蚜虫|螟虫|稻飞虱|致灾因子危险性|承灾体暴露度|承灾体脆弱性|孕灾环境|防灾减灾能力|风险指数|风险等级|轻[度]?风险|中[度]?风险|重[度]?风险"),
    ("气象要素", "≥?10℃活动积温|≥?0℃积温|有效积温|活动积温|年降水量|生长季降水|日照时数|太阳辐射|光合有效辐射|年均?气温|极端最低气温|极端最高气温|无霜期|初霜日|终霜日|相对湿度|平均风速|蒸发量"),
    ("生育期", "播种期|出苗期|三叶期|分枝期|开花期|结荚期|鼓粒期|成熟期|拔节期|抽穗期|灌浆期|黄熟期|乳熟期|越冬期|返青期|分蘖期|生物学下限温度|有效积温|播种.*?出苗|出苗.*?开花|开花.*?成熟|营养生长期|生殖生长期"),
    ("品质评价", "蛋白质|湿面筋|容重|稳定时间|沉降值|降落值|强筋|中强筋|弱筋|粗蛋白|氨基酸|含油量|糖度|酸度|出粉率|出米率"),
    ("产量分级", "光温生产潜力|气候生产潜力|产量潜力|kg/?ha|kg/?hm²|公斤/?亩|单产|总产|生产力|高产[区]?|中产[区]?|低产[区]?"),
)
UNIVERSAL = r"DEM|NDVI|GIS|AHP|ET0|Kc|FCV|≥\p{Nd}+℃|≥\p{Nd}+mm|≥\p{Nd}+cm|℃·d|mm·d|hm²|km²|m/s"


def topics(text: Column, families: tuple[tuple[str, str], ...] = TOPICS, most: int = 3, default: str = UNTOLD) -> Column:
    """Names of the first families whose pattern occurs, in their order."""
    hit = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in families]))
    return F.when(F.size(hit) > 0, F.slice(hit, 1, most)).otherwise(F.array(F.lit(default)))


def entities(text: Column, found: Column, families: tuple[tuple[str, str], ...] = ENTITIES, universal: str = UNIVERSAL, most: int = 5) -> Column:
    """Distinct terms of the topics found, in the order of the families and the text, filled up with universal ones, at most five."""
    every = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    none = F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.flatten(F.array(*[F.when(F.array_contains(found, n), every(p)).otherwise(none) for n, p in families], every(universal)))), 1, most)


def heading_split(df: DataFrame, key: str, text: str, least: int = 3000, marks: str = "{3,4}") -> DataFrame:
    """(key, sub, title, body): contents over `least` characters cut before each heading of third level (or of `marks` signs); others whole."""
    long = df.filter(F.length(text) > least).select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    head = F.col("line").rlike(rf"^#{marks}\s+\S")
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    long = long.withColumn("sub", F.sum(head.cast("int")).over(w).cast("int")).withColumn("head", head)
    cut = long.groupBy(key, "sub").agg(F.min(F.when(F.col("head"), F.regexp_replace("line", r"^#+\s+", ""))).alias("title"), F.array_join(F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("at", F.when(~F.col("head"), F.col("line")).alias("v")))), lambda x: x["v"])), "\n").alias("body"))
    whole = df.filter(F.length(text) <= least).select(key, F.lit(0).alias("sub"), F.lit(None).cast("string").alias("title"), F.col(text).alias("body"))
    return whole.unionByName(cut)


def quality(df: DataFrame, text: str) -> DataFrame:
    reason = T.quality_reasons(F.col(text))
    return df.withColumn("quality_reason", reason).withColumn("quality", F.when(reason == "", "high").otherwise("low"))
