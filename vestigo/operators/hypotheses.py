"""Vehicle hypotheses of a case: merging, category, component checks, expansion, final ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vestigo.functions.numbers import clamp, exact_sum, rnd
from vestigo.functions.text import norm_upper
from vestigo.operators.spread import settle
from vestigo.session import stash

# Brand aliases.
BRAND_ALIASES = {
    "VW": "VOLKSWAGEN",
    "VOLKSWAGEN CAMINHOES E ONIBUS": "VOLKSWAGEN",
    "VWCO": "VOLKSWAGEN",
    "MERCEDES BENZ": "MERCEDES BENZ",
    "MERCEDES": "MERCEDES BENZ",
    "GM": "CHEVROLET",
    "CHEVY": "CHEVROLET",
    "YAMAHA MOTOR": "YAMAHA",
    "HONDA MOTO": "HONDA",
    "SCANIA DO BRASIL": "SCANIA",
}
# Weight of each component by vehicle category.
COMPONENT_WEIGHTS = {
    "AUTOMOVEL": {
        "grade_dianteira": 14.0,
        "farois_dianteiros": 14.0,
        "lanternas_traseiras": 14.0,
        "emblema_frontal": 12.0,
        "linhas_portas": 10.0,
        "design_carroceria": 10.0,
        "parachoque": 8.0,
        "retrovisores": 8.0,
        "rodas_originais": 8.0,
        "capo_dianteiro": 6.0,
        "tampa_traseira": 6.0,
    },
    "MOTOCICLETA": {
        "farois_dianteiros": 16.0,
        "lanternas_traseiras": 14.0,
        "retrovisores": 14.0,
        "rodas_originais": 14.0,
        "emblema_frontal": 12.0,
        "design_carroceria": 12.0,
        "parachoque": 8.0,
        "entradas_ar_frisos": 10.0,
    },
    "CAMINHAO": {
        "grade_dianteira": 18.0,
        "farois_dianteiros": 16.0,
        "retrovisores": 14.0,
        "parachoque": 12.0,
        "design_carroceria": 12.0,
        "entradas_ar_frisos": 10.0,
        "lanternas_traseiras": 8.0,
        "rodas_originais": 10.0,
    },
}
LIMITED = "limitado_vista"
UNKNOWN = ("indefinido", "nao_detectado", "nao_detectada", "ausente")
WEAK = ("sinal_fraco", "linha_parcial", "fraca", "parcial")
# Keywords and base scores of the categories, in the order that settles ties.
BASE_SCORES = {"AUTOMOVEL": 35.0, "MOTOCICLETA": 27.0, "CAMINHAO": 27.0}
KEYWORDS = {
    "AUTOMOVEL": (
        "HATCH", "SEDAN", "SUV", "PICAPE", "CARRO", "AUTOMOVEL", "ONIX", "HB20", "UNO", "MOBI", "GOL", "KWID",
    ),
    "MOTOCICLETA": (
        "MOTO", "MOTOCICLETA", "SCOOTER", "CG", "BIZ", "PCX", "XRE", "FAZER", "NMAX", "YAMAHA", "HONDA",
    ),
    "CAMINHAO": (
        "CAMINHAO", "TRUCK", "CARRETA", "CAVALO MECANICO", "ATEGO", "ACTROS", "SCANIA", "VOLVO", "TECTOR",
        "CONSTELLATION", "METEOR", "RODOTREM",
    ),
}
KEYWORD_POINTS = 2.6
HYPOTHESIS_CAP, EVIDENCE_CAP = 8, 8
LOCAL_SHARE, VISION_SHARE = 0.62, 0.38
SEED_CONFIDENCE, WIDE_SEED_CONFIDENCE = 12.0, 10.0
MIN_CANDIDATES, MAX_CANDIDATES = 3, 5


def _brand(raw: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in BRAND_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, raw), raw)


def brand_name(c: Column) -> Column:
    return _brand(norm_upper(c))


def _keyed(df: DataFrame) -> DataFrame:
    usable = df.where((F.trim("maker") != "") & (F.trim("model") != ""))
    named = settle(usable.withColumn("maker", norm_upper(F.col("maker"))).withColumn("model", norm_upper(F.col("model"))), "maker", "model")
    return named.withColumn("maker", _brand(F.col("maker")))


def merge_hypotheses(cases: DataFrame, local: DataFrame, vision: DataFrame, principal: DataFrame, seeds: DataFrame) -> DataFrame:
    """Candidates of each case from its local, vision and principal hypotheses; seeds where there are none.

    `cases`: case_id, category; `local`, `vision`: case_id, pos (0-based), maker, model, confidence,
    evidence array; `principal`: case_id, maker, model, confidence; `seeds`: category, seq, maker, model.
    """
    none = F.array().cast("array<string>")

    def side(df: DataFrame, turn: int, role: str) -> DataFrame:
        return _keyed(df).select(
            "case_id",
            "maker",
            "model",
            F.lit(turn).alias("turn"),
            F.col("pos").cast("bigint").alias("pos"),
            F.when(F.lit(role != "vision"), F.col("confidence")).alias("local"),
            F.when(F.lit(role == "vision"), F.col("confidence")).alias("vision"),
            "evidence",
        )

    first = lambda df: df.where(F.col("pos") < HYPOTHESIS_CAP)
    lead = principal.withColumn("pos", F.lit(0)).withColumn("evidence", none)
    pooled = side(first(local), 0, "local").unionByName(side(first(vision), 1, "vision")).unionByName(side(lead, 2, "principal"))
    # At most 17 hypotheses of a case reach this point, so the evidence lists are short.
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "pos", "evidence"))), lambda x: x["evidence"]
    )
    # Stored, as the cases without any are found from it, too.
    merged = stash(pooled.groupBy("case_id", "maker", "model").agg(
        F.coalesce(F.max("local"), F.lit(0.0)).alias("local_conf"),
        F.coalesce(F.max("vision"), F.lit(0.0)).alias("vision_conf"),
        F.min(F.struct("turn", "pos")).alias("first"),
        F.slice(F.array_distinct(F.filter(F.flatten(listed), lambda e: F.trim(e) != "")), 1, EVIDENCE_CAP).alias("evidence"),
    ), "merged-hypotheses")
    both = (F.col("local_conf") > 0) & (F.col("vision_conf") > 0)
    base = F.when(both, F.col("local_conf") * LOCAL_SHARE + F.col("vision_conf") * VISION_SHARE).otherwise(
        F.greatest("local_conf", "vision_conf")
    )
    own = merged.select(
        "case_id", "maker", "model", rnd(base, 2).alias("base_conf"), "evidence", F.lit(False).alias("synthetic"),
        (F.col("first.turn") * 100 + F.col("first.pos")).cast("bigint").alias("seq"),
    )
    bare = cases.join(merged.select("case_id").distinct(), "case_id", "left_anti")
    seeded = bare.join(seeds, "category").select(
        "case_id",
        "maker",
        "model",
        F.lit(SEED_CONFIDENCE).alias("base_conf"),
        F.array(F.lit("seed_categoria_sem_hipotese_local")).alias("evidence"),
        F.lit(True).alias("synthetic"),
        F.col("seq").cast("bigint").alias("seq"),
    )
    return own.unionByName(seeded)


def _fields(maker: Column, model: Column, conf: Column, synthetic: bool, seq: Column) -> Column:
    return F.struct(
        maker.alias("maker"),
        model.alias("model"),
        conf.cast("double").alias("base_conf"),
        F.lit(synthetic).alias("synthetic"),
        seq.cast("bigint").alias("seq"),
    )


def _ordered(df: DataFrame, key: str, cap: int, item: Column, order: list[str]) -> DataFrame:
    """First `cap` items of each key as an array; the cap is applied before anything is collected."""
    w = Window.partitionBy(key).orderBy(*order)
    top = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap)
    listed = F.array_sort(F.collect_list(F.struct(F.col("_n"), item.alias("v"))))
    return top.groupBy(key).agg(F.transform(listed, lambda x: x["v"]).alias("items"))


def expand_similar(
    cases: DataFrame, candidates: DataFrame, local: DataFrame, siblings: DataFrame, seeds: DataFrame
) -> DataFrame:
    """Fill up each case to three candidates: siblings of the leading one, then local hypotheses, then
    seeds of the category; best five stay.

    `cases`: case_id, category; `candidates`: merge_hypotheses output; `siblings`: maker, seq, model;
    `seeds`: category, seq, maker, model. The leading candidate always gains one sibling if there is one.
    A case has at most 17 candidates of its own, so of each further list only the first 23 entries can
    matter: three of them are new whatever the case already has.
    """
    enough = 2 * HYPOTHESIS_CAP + 1 + 2 * MIN_CANDIDATES
    own_item = F.struct((-F.col("base_conf")).alias("neg"), F.col("seq"), "maker", "model", "base_conf", "synthetic")
    own = candidates.groupBy("case_id").agg(F.array_sort(F.collect_list(own_item)).alias("_own"))
    heard = (
        _keyed(local)
        .groupBy("case_id", "maker", "model")
        .agg(F.min_by(F.col("confidence"), "pos").alias("conf"), F.min("pos").alias("seq"))
    )
    heard_item = _fields(F.col("maker"), F.col("model"), rnd(F.col("conf") * 0.75, 2), False, F.col("seq"))
    locals_ = _ordered(heard, "case_id", enough, heard_item, ["seq", "maker", "model"]).withColumnRenamed("items", "_local")
    kin_item = _fields(F.col("maker"), F.col("model"), F.lit(0.0), True, F.col("seq"))
    kin = _ordered(siblings, "maker", enough, kin_item, ["seq", "model"]).select(
        F.col("maker").alias("_top"), F.col("items").alias("_kin")
    )
    seed_item = _fields(F.col("maker"), F.col("model"), F.lit(WIDE_SEED_CONFIDENCE), True, F.col("seq"))
    sown = _ordered(seeds, "category", enough, seed_item, ["seq", "maker", "model"]).withColumnRenamed("items", "_seeds")
    none = F.array().cast("array<struct<maker:string,model:string,base_conf:double,synthetic:boolean,seq:bigint>>")
    lead = F.get("_own", F.lit(0))
    joined = (
        cases.select("case_id", "category")
        .join(own, "case_id", "left")
        .withColumn("_top", lead["maker"])
        .join(kin, "_top", "left")
        .join(locals_, "case_id", "left")
        .join(sown, "category", "left")
    )

    def names(items: Column) -> Column:
        return F.transform(items, lambda x: F.concat_ws("|", x["maker"], x["model"]))

    def fresh(items: Column, known: Column) -> Column:
        return F.filter(
            F.coalesce(items, none), lambda x: ~F.array_contains(known, F.concat_ws("|", x["maker"], x["model"]))
        )

    room = lambda n: F.greatest(F.lit(0), F.lit(MIN_CANDIDATES) - n)
    plain = F.transform("_own", lambda x: _fields(x["maker"], x["model"], x["base_conf"], False, x["seq"]).withField("synthetic", x["synthetic"]))
    near_conf = rnd(F.greatest(F.lit(8.0), lead["base_conf"] * 0.72), 2)
    first = joined.withColumn("_0", F.coalesce(plain, none)).withColumn("_near", near_conf)
    first = settle(first.withColumn("_k0", names(F.col("_0"))), "_0", "_near", "_k0")
    kin_left = F.slice(fresh(F.col("_kin"), F.col("_k0")), F.lit(1), F.greatest(F.lit(1), room(F.size("_0"))))
    second = settle(
        first.withColumn("_1", F.zip_with(kin_left, F.array_repeat("_near", F.size(kin_left)), lambda x, c: x.withField("base_conf", c))), "_1"
    )
    second = second.withColumn("_k1", F.concat("_k0", names(F.col("_1"))))
    third = settle(
        second.withColumn("_2", F.slice(fresh(F.col("_local"), F.col("_k1")), F.lit(1), room(F.size("_k1")))), "_2"
    )
    third = third.withColumn("_k2", F.concat("_k1", names(F.col("_2"))))
    filled = settle(
        third.withColumn("_3", F.slice(fresh(F.col("_seeds"), F.col("_k2")), F.lit(1), room(F.size("_k2")))), "_3"
    )

    def turned(name: str, turn: int) -> Column:
        return F.transform(
            name,
            lambda x: F.struct(
                (-x["base_conf"]).alias("neg"), F.lit(turn).alias("turn"), x["seq"].alias("seq"), x["maker"].alias("maker"),
                x["model"].alias("model"), x["base_conf"].alias("base_conf"), x["synthetic"].alias("synthetic"),
            ),
        )

    ranked = F.slice(F.array_sort(F.concat(*[turned(f"_{t}", t) for t in range(4)])), 1, MAX_CANDIDATES)
    return filled.select("case_id", "category", F.posexplode(ranked).alias("_p", "c")).select(
        "case_id", "c.maker", "c.model", "category", "c.base_conf", "c.synthetic", (F.col("_p") + 1).cast("bigint").alias("rank")
    )


def component_checks(candidates: DataFrame, components: DataFrame, rules: DataFrame) -> DataFrame:
    """One row for the candidates of a case that are judged alike: `candidates`, each distinct one as a struct,
    the `checks` they share (components with points and verdict), and `copies`, the number of rows each came in.

    A model with its own rules is judged by those, any other by the weights of its category; a candidate
    without either goes. `candidates`: case_id, maker, model, category and more; `components`: case_id,
    component, status, confidence; `rules`: maker, model, seq, component, statuses, weight.

    A case's candidates without rules share its checks, which are made once, from the list of its components
    that are asked for; no row per check is moved.
    """
    own = rules.groupBy("maker", "model").agg(F.array_sort(F.collect_list(F.struct("seq", "component", "weight", "statuses"))).alias("_rules"))

    def entry(i: int, name: str, weight: float) -> Column:
        return F.struct(
            F.lit(i).alias("seq"),
            F.lit(name).alias("component"),
            F.lit(weight).alias("weight"),
            F.lit(None).cast("array<string>").alias("statuses"),
        )

    weights = F.create_map(
        *[
            x
            for category, table in COMPONENT_WEIGHTS.items()
            for x in (F.lit(category), F.array(*[entry(i, c, w) for i, (c, w) in enumerate(table.items())]))
        ]
    )
    known = list(dict.fromkeys(name for table in COMPONENT_WEIGHTS.values() for name in table))
    ruled = rules.select("component").distinct().withColumn("_ruled", F.lit(True))
    asked_for = components.join(F.broadcast(ruled), "component", "left").where(F.col("component").isin(*known) | F.col("_ruled"))
    read = asked_for.groupBy("case_id").agg(F.collect_list(F.struct("component", "status", "confidence")).alias("_read"))
    nothing = F.array(F.struct(F.lit(None).cast("string").alias("component"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("double").alias("confidence")))

    def check(rule: Column, found: Column) -> Column:
        status, conf = F.coalesce(found["status"], F.lit("indefinido")), F.coalesce(found["confidence"], F.lit(0.0))
        by_rule = rule["statuses"].isNotNull()
        fits = F.array_contains(rule["statuses"], status)
        limited = status.startswith(LIMITED)
        seen = ~status.isin(*UNKNOWN)
        share = (
            F.when(by_rule & fits, F.least(F.lit(1.0), F.greatest(F.lit(0.3), conf / 100.0)))
            .when(limited, 0.45)
            .when(by_rule & status.isin(*WEAK), 0.35)
            .when(by_rule, 0.0)
            .when(seen, F.least(F.lit(1.0), F.greatest(F.lit(0.28), conf / 100.0)))
            .when(conf >= 36.0, 0.22)
            .otherwise(0.0)
        )
        matched = F.when(by_rule, fits & (conf >= 42.0)).otherwise(seen & (conf >= 40.0))
        return F.struct(
            rule["seq"].alias("seq"),
            rule["component"].alias("component"),
            rule["weight"].alias("weight"),
            status.alias("status"),
            (rule["weight"] * share).alias("points"),
            F.when(limited, "limited").when(matched, "match").otherwise("mismatch").alias("verdict"),
        )

    def judged(rule: Column) -> Column:
        found = F.filter(F.coalesce("_read", nothing), lambda x: x["component"] == rule["component"])
        return F.transform(F.when(F.size(found) > 0, found).otherwise(nothing), lambda x: check(rule, x))

    distinct = candidates.groupBy(*candidates.columns).agg(F.count(F.lit(1)).cast("int").alias("copies"))
    ruled_by = distinct.join(F.broadcast(own), ["maker", "model"], "left")
    if_ruled = lambda name: F.when(F.col("_rules").isNotNull(), F.col(name)).alias(f"_{name}")
    alike = ruled_by.groupBy(
        "case_id", if_ruled("maker"), if_ruled("model"), F.when(F.col("_rules").isNull(), F.col("category")).alias("_category"), "copies"
    ).agg(F.first("_rules").alias("_rules"), F.collect_list(F.struct(*candidates.columns)).alias("candidates"))
    asked = F.coalesce("_rules", F.element_at(weights, F.col("_category")))
    met = settle(alike.join(read, "case_id", "left").withColumn("_asked", asked).where(F.size("_asked") > 0), "_asked")
    return met.select("candidates", F.flatten(F.transform("_asked", judged)).alias("checks"), "copies")


def component_evaluation(checks: DataFrame) -> DataFrame:
    """Alignment and verdict lists of each candidate from its checks, each counted as often as the candidate came."""
    checks = settle(checks, "checks")
    exact = lambda c: c.cast("decimal(28,12)")

    def summed(name: str) -> Column:
        # one step of precision at a time, as the sum of decimals over rows has it
        total = F.aggregate("checks", exact(F.lit(0)), lambda t, c: exact(t + exact(c[name])))
        return exact(total * F.col("copies")).cast("double")

    def listed(verdict: str, cap: int) -> Column:
        # A candidate has at most eleven components.
        mine = F.filter("checks", lambda c: c["verdict"] == verdict)
        items = F.transform(mine, lambda c: F.struct(c["seq"].alias("seq"), F.concat_ws(":", c["component"], c["status"]).alias("s")))
        items = F.when(F.col("copies") > 1, F.flatten(F.array_repeat(items, F.col("copies")))).otherwise(items)
        return F.concat_ws(",", F.transform(F.slice(F.array_sort(items), 1, cap), lambda x: x["s"]))

    total = summed("weight")
    against = F.size(F.filter("checks", lambda c: c["verdict"] == "mismatch")) * F.col("copies")
    judged = checks.select(
        "candidates",
        rnd(F.when(total > 0, summed("points") / total * 100.0).otherwise(0.0), 2).alias("component_conf"),
        listed("match", 8).alias("matches"),
        listed("mismatch", 8).alias("mismatches"),
        listed("limited", 6).alias("limited"),
        against.cast("bigint").alias("mismatch_count"),
    )
    judged = settle(judged, *[c for c in judged.columns if c != "candidates"])
    return judged.select(F.explode("candidates").alias("_c"), *judged.columns[1:]).select("_c.*", *judged.columns[1:])


def infer_category(cases: DataFrame) -> DataFrame:
    """Vehicle category of a case from geometry and words. `cases`: case_id, aspect, compact, view, told."""
    text = norm_upper(F.col("told"))
    aspect, compact = F.col("aspect"), F.col("compact")
    geometry = {
        "AUTOMOVEL": F.when(compact, 8.0).otherwise(0.0)
        + F.when(norm_upper(F.col("view")).isin("FRONTAL", "TRASEIRA"), 2.5).otherwise(0.0),
        "MOTOCICLETA": F.when(aspect.between(0.9, 1.45) & ~compact, 9.0).otherwise(0.0),
        "CAMINHAO": F.when(aspect >= 2.75, 10.0).otherwise(0.0),
    }
    # Each step is read many times over by the next.
    told = settle(cases.withColumn("_text", text), "_text")
    for category, words in KEYWORDS.items():
        hits = F.lit(0)
        for word in words:
            hits = hits + F.col("_text").contains(word).cast("int")
        told = told.withColumn(f"_{category}", F.lit(BASE_SCORES[category]) + geometry[category] + hits * KEYWORD_POINTS)
    names = list(BASE_SCORES)
    told = settle(told, *[f"_{n}" for n in names])
    # Sorted by falling score; the order of the table settles ties.
    ranked = F.array_sort(
        F.array(*[F.struct((-F.col(f"_{n}")).alias("neg"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, n in enumerate(names)])
    )
    scored = settle(told.withColumn("_ranked", ranked), "_ranked").withColumn("_top", -F.get("_ranked", F.lit(0))["neg"])
    top = F.col("_top")
    second = -F.get("_ranked", F.lit(1))["neg"]
    total = F.greatest(F.lit(1.0), sum((F.col(f"_{n}") for n in names), F.lit(0.0)))
    confidence = clamp(top / total * 100.0, 35.0, 99.0)
    name = F.get("_ranked", F.lit(0))["name"]
    unsure = (name != "AUTOMOVEL") & (top - second < 1.6) & (top < 40.0)
    judged = scored.select(
        "case_id",
        F.when(unsure, "AUTOMOVEL").otherwise(name).alias("category"),
        rnd(F.when(unsure, F.greatest(F.lit(38.0), confidence - 8.0)).otherwise(confidence), 2).alias("category_conf"),
        *[rnd(F.col(f"_{n}"), 2).alias(f"score_{n.lower()}") for n in names],
    )
    return settle(judged, "category", "category_conf")


def category_alignment(candidate: Column, inferred: Column, confidence: Column) -> Column:
    agree = rnd(F.least(F.lit(4.8), F.greatest(F.lit(0.6), confidence / 22.0)), 2)
    return F.when(candidate == inferred, agree).when(confidence >= 62.0, -8.0).when(confidence >= 48.0, -4.5).otherwise(-2.0)


def final_candidate_rank(evaluated: DataFrame, categories: DataFrame, web: DataFrame | None = None) -> DataFrame:
    """Final confidence and rank of the candidates of each case.

    `evaluated`: component_evaluation output with base_conf, category, synthetic; `web`: case_id, maker,
    model, web_score, confirmation_count, conflict_count, or None where the web was not asked.
    """
    key = ["case_id", "maker", "model"]
    inferred = categories.select("case_id", F.col("category").alias("_cat"), F.col("category_conf").alias("_conf"))
    joined = evaluated.join(inferred, "case_id")
    component = F.coalesce("component_conf", F.lit(0.0))
    if web is None:
        joined = joined.withColumn("confirmation_count", F.lit(0).cast("bigint")).withColumn("conflict_count", F.lit(0).cast("bigint"))
        blend = F.col("base_conf") * 0.56 + component * 0.44
    else:
        joined = joined.join(web.select(*key, "web_score", "confirmation_count", "conflict_count"), key, "left").fillna(
            0, ["web_score", "confirmation_count", "conflict_count"]
        )
        blend = (
            F.col("base_conf") * 0.34
            + component * 0.33
            + F.col("web_score") * 0.33
            + F.col("confirmation_count") * 2.0
            - F.col("conflict_count") * 2.2
        )
    final = (
        blend
        + category_alignment(F.col("category"), F.col("_cat"), F.col("_conf"))
        - F.when(F.coalesce("mismatch_count", F.lit(0)) >= 3, 5.0).otherwise(0.0)
        - F.when(F.col("synthetic"), 10.0).otherwise(0.0)
    )
    scored = joined.withColumn("final_conf", rnd(clamp(final, 0.0, 99.0), 2))
    # A case has at most five candidates here.
    best = Window.partitionBy("case_id").orderBy(F.col("final_conf").desc(), "maker", "model")
    return (
        scored.withColumn("rank", F.row_number().over(best).cast("bigint"))
        .withColumn("next_conf", F.lead("final_conf").over(best))
        .select(
            *key, "final_conf", "rank", "next_conf", "confirmation_count", "conflict_count",
            F.coalesce("mismatch_count", F.lit(0)).cast("bigint").alias("mismatch_count"), "synthetic",
            F.col("_conf").alias("category_conf"),
        )
    )


def case_verdict(ranked: DataFrame) -> DataFrame:
    """Winner of each case, `incerto` if it is weak, closely followed, or of unclear category."""
    gap = F.coalesce(F.col("final_conf") - F.col("next_conf"), F.lit(99.0))
    unsure = (F.col("final_conf") < 80.0) | (gap < 6.0) | (F.col("category_conf") < 52.0)
    return ranked.where(F.col("rank") == 1).select(
        "case_id", "maker", "model", "final_conf", rnd(gap, 2).alias("gap"), F.when(unsure, "incerto").otherwise("ok").alias("status")
    )


def discarded_reasons(ranked: DataFrame) -> DataFrame:
    """Why each runner-up lost against the winner of its case."""
    # Read off the rows of the case, which lie together already, so the ranking is made once.
    case = Window.partitionBy("case_id")
    of_first = lambda name: F.max(F.when(F.col("rank") == 1, F.col(name))).over(case)
    placed = ranked.withColumn("_won", of_first("rank")).withColumn("_best", of_first("final_conf")).withColumn("_hits", of_first("confirmation_count"))
    losers = placed.where(F.col("rank").between(2, 6) & F.col("_won").isNotNull() & F.col("case_id").isNotNull())
    reasons = F.array_compact(
        F.array(
            F.when(F.col("final_conf") <= F.col("_best") - 6.0, "confianca_global_inferior_ao_melhor_candidato"),
            F.when(F.col("mismatch_count") > 0, "divergencia_de_componentes_visuais"),
            F.when(F.col("confirmation_count") < F.col("_hits"), "menos_confirmacoes_independentes"),
            F.when(F.col("conflict_count") > 0, "conflito_com_modelos_semelhantes"),
            F.when(F.col("synthetic"), "candidato_expandido_por_semelhanca_sem_confirmacao_suficiente"),
        )
    )
    low = F.array(F.lit("baixo_desempenho_no_ranqueamento_cruzado"))
    listed = F.when((F.size(reasons) == 0) & (F.col("final_conf") < 55.0), low).otherwise(reasons)
    return losers.select("case_id", "maker", "model", "rank", "final_conf", F.concat_ws(",", listed).alias("reasons"))
