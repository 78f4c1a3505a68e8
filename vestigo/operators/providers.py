"""Provider records: alias folding, trust, weighted field consensus, masking, official validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vestigo.functions.numbers import clamp, exact_sum, rnd
from vestigo.functions.plates import norm_plate
from vestigo.functions.text import compact, mask_tail, norm_upper
from vestigo.operators.spread import settle
from vestigo.session import stash

# Field aliases, first one present wins.
ALIASES = {
    "placa": ["placa", "license_plate", "plate", "plate_number"],
    "fabricante": ["fabricante", "marca", "make", "brand", "manufacturer"],
    "marca_modelo": ["marca_modelo", "marcaModelo", "brandModel", "brand_model", "brand_model_name"],
    "modelo": ["modelo", "model"],
    "ano": [
        "ano",
        "ano_modelo",
        "anoModelo",
        "year",
        "modelYear",
        "ano_fabricacao",
        "anoFabricacao",
        "fabrication_year",
        "model_year",
    ],
    "cor": ["cor", "corPredominante", "color"],
    "categoria": ["categoria", "category"],
    "uf": ["uf", "estado", "estadoSigla", "state"],
    "cidade": ["cidade", "city", "municipio", "town"],
    "municipio": ["municipio", "county"],
    "chassi": ["chassi", "vin", "chassis", "numero_chassi"],
    "renavam": ["renavam", "codigo_renavam", "renavam_code"],
    "proprietario": ["proprietario", "owner", "nome_proprietario", "owner_name"],
    "cpf_cnpj": ["cpf_cnpj", "documento", "document", "owner_document"],
    "endereco": ["endereco", "address"],
    "estampador": ["estampador", "plate_maker", "emplacador"],
    "codigo_seguranca_crv": ["codigo_seguranca_crv", "crv_security_code", "codigo_crv"],
    "serial_qrcode": ["serial_qrcode", "qr_code_serial", "qrcode_serial", "qr_serial"],
    "restricoes": ["restricoes", "restrictions", "debts_summary"],
    "fonte": ["fonte", "source"],
}
# Nested objects merged over the root, later ones first to be asked.
NESTED = ["vehicle", "veiculo", "owner", "proprietario"]
# Host parts and the source kind they mean, first match wins; trust by kind.
HOST_KINDS = [
    ("gov.br", "official_gov_br"),
    ("serpro", "official_serpro"),
    ("senatran", "official_senatran"),
    ("denatran", "official_senatran"),
    ("prodesp", "official_prodesp"),
    ("detran.sp", "official_prodesp"),
    ("sinesp", "official_sinesp"),
    ("usezapay", "official_authorized"),
    ("fipe.parallelum.com.br", "open_data_reference"),
    ("deividfortuna.github.io", "open_data_reference"),
]
TRUST = {
    "official_gov_br": 1.0,
    "official_serpro": 1.0,
    "official_senatran": 1.0,
    "official_prodesp": 0.97,
    "official_sinesp": 0.95,
    "official_authorized": 0.92,
    "open_data_reference": 0.76,
    "external_provider": 0.6,
}
# Field groups.
REFERENCE_FIELDS = ["fipe_preco_medio", "fipe_codigo", "fipe_ano_modelo", "fipe_mes_referencia", "fipe_combustivel"]
BASIC = ["placa", "fabricante", "marca_modelo", "modelo", "ano", "cor", "categoria", "uf", "cidade", "municipio", "restricoes"]
PUBLIC = [*BASIC, *REFERENCE_FIELDS]
SENSITIVE = [
    "chassi",
    "renavam",
    "proprietario",
    "cpf_cnpj",
    "endereco",
    "estampador",
    "codigo_seguranca_crv",
    "serial_qrcode",
]
VOTED = [*BASIC, "estampador", "fipe_preco_medio", "fipe_codigo", "fipe_ano_modelo"]
# Characters of a masked field left to see; 0 hides it whole.
MASKS = {
    "chassi": 4,
    "renavam": 4,
    "proprietario": 0,
    "cpf_cnpj": 0,
    "endereco": 0,
    "estampador": 0,
    "codigo_seguranca_crv": 3,
    "serial_qrcode": 4,
}
HIDDEN = "[restrito]"
PENDING = ("pending_async", "pendente_webhook", "aguardando_webhook")


def source_kind(host: Column) -> Column:
    kind = F.lit("external_provider")
    for part, name in reversed(HOST_KINDS):
        kind = F.when(host.contains(part), name).otherwise(kind)
    return kind


def trust_weight(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TRUST.items() for x in kv])
    return F.coalesce(F.try_element_at(table, kind), F.lit(TRUST["external_provider"]))


def unify_provider_records(raw: DataFrame, masked: bool = True) -> DataFrame:
    """Raw answers (`payload` JSON, `host`) to one wide record each; blanks are null.

    Each level of nesting is parsed once, into the fields that any alias names.
    """
    names = list(dict.fromkeys([*(a for aliases in ALIASES.values() for a in aliases), *NESTED]))
    schema = ", ".join(f"`{n}` string" for n in names)
    parsed = raw.withColumn("_root", F.from_json("payload", schema))
    for name in NESTED:
        parsed = parsed.withColumn(f"_in_{name}", F.from_json(F.col("_root")[name], schema))
    levels = [f"_in_{name}" for name in reversed(NESTED)] + ["_root"]

    def field(aliases: list[str]) -> Column:
        return F.nullif(F.coalesce(*[F.col(level)[a] for a in aliases for level in levels]), F.lit(""))

    columns = []
    for name, aliases in ALIASES.items():
        value = field(aliases)
        if name == "fonte":
            value = F.coalesce(value, F.lit("provedor_externo"))
        columns.append(value.alias(name))
    kind = source_kind(F.lower("host"))
    keep = [c for c in raw.columns if c != "payload"]
    wide = parsed.select(*keep, kind.alias("source_kind"), trust_weight(kind).alias("trust_weight"), *columns)
    # Later steps read every field many times over; the lookups are done once.
    wide = settle(wide, "source_kind", *ALIASES)
    return mask_sensitive(wide) if masked else wide


def mask_sensitive(records: DataFrame) -> DataFrame:
    """Hide personal and security fields; to be called before any write."""

    def hidden(name: str, tail: int) -> Column:
        c = F.col(name)
        shown = mask_tail(F.col(f"_bare_{name}"), tail) if tail > 0 else F.lit(HIDDEN)
        return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", c).otherwise(shown)

    present = {n: tail for n, tail in MASKS.items() if n in records.columns}
    # blanks are taken out once, then measured and cut
    bare = {f"_bare_{n}": compact(F.trim(F.col(n))) for n, tail in present.items() if tail > 0}
    masked = records.withColumns(bare).withColumns({n: hidden(n, tail) for n, tail in present.items()})
    return masked.drop(*bare)


def _has(records: DataFrame, name: str) -> Column:
    if name not in records.columns:
        return F.lit(False)
    return F.trim(F.coalesce(F.col(name), F.lit(""))) != ""


def _count(records: DataFrame, names: list[str]) -> Column:
    total = F.lit(0)
    for name in names:
        total = total + _has(records, name).cast("int")
    return total


def official_validation(records: DataFrame, strict: bool = False) -> DataFrame:
    """Official flag, fields found and missing, notes and status of each record."""
    # Each field is looked at once; lists, counts and notes read the flags.
    asked = [*BASIC, *SENSITIVE]
    told = records.withColumns({f"_has_{n}": _has(records, n) for n in asked})
    has = lambda name: F.col(f"_has_{name}")
    official = F.col("source_kind").startswith("official_")
    pending = F.lower(F.trim(F.coalesce("lookup_state", F.lit("")))).isin(*PENDING)
    listed = lambda *rules: F.array_remove(F.array(*[F.when(rule, name).otherwise("") for rule, name in rules]), "")
    found = lambda names: listed(*[(has(n), n) for n in names])
    count = lambda names: sum((has(n).cast("int") for n in names), F.lit(0))
    missing = listed(*[(~has(n), n) for n in BASIC])
    personal = has("proprietario") | has("cpf_cnpj")
    notes = listed(
        (~official, "fonte_nao_classificada_como_oficial"),
        (F.lit(strict) & ~official, "consulta_nao_promovida_a_validacao_oficial"),
        (pending, "consulta_assincrona_pendente"),
        (has("chassi"), "chassi_detectado_em_fluxo_restrito"),
        (personal, "dados_pessoais_detectados"),
        (count(BASIC) == 0, "campos_publicos_incompletos"),
    )
    status = (
        F.when(pending, "pendente_webhook")
        .when(official, "ok")
        .otherwise("nao_oficial" if strict else "sem_validacao_oficial")
    )
    return told.withColumns(
        {
            "status": status,
            "is_official": official,
            "public_found": found(BASIC),
            "public_missing": missing,
            "sensitive_found": found(SENSITIVE),
            "public_count": count(BASIC),
            "sensitive_count": count(SENSITIVE),
            "notes": notes,
        }
    ).drop(*[f"_has_{n}" for n in asked])


def score_records(validated: DataFrame) -> DataFrame:
    """Trust, completeness and plate agreement of each record, 0-100. `plate` is the plate asked for."""
    has = lambda name: _has(validated, name)
    points = lambda condition, value: F.when(condition, value).otherwise(0.0)
    asked, own = F.col("_asked"), F.col("_own")
    # `PUBLIC` is `BASIC`, which is counted already, and the reference fields.
    public = F.col("public_count") + _count(validated, REFERENCE_FIELDS)
    total = (
        rnd(F.col("trust_weight") * 28.0, 1)
        + F.least(F.lit(36.0), public * 4.5)
        + F.least(F.lit(12.0), F.col("sensitive_count") * 2.0)
        + points(has("fabricante") & has("modelo"), 7.0)
        + points(has("ano"), 4.0)
        + points(has("cor"), 2.0)
        + points(has("uf") | has("cidade") | has("municipio"), 3.0)
        + points(has("fipe_preco_medio") | has("fipe_codigo"), 4.0)
        + points(F.col("is_official"), 18.0)
        + points(F.col("public_count") >= 5, 3.0)
        + points((F.col("sensitive_count") > 0) & F.col("is_official"), 2.0)
        + F.when(asked == "", 0.0).when(own == "", -8.0).when(own == asked, 8.0).otherwise(-25.0)
    )
    plates = validated.withColumns({"_asked": norm_plate(F.col("plate")), "_own": norm_plate(F.col("placa"))})
    scored = plates.withColumn("_total", total).drop("_asked", "_own")
    return scored.withColumn("lookup_score", rnd(clamp(F.col("_total"), 0.0, 100.0), 1)).drop("_total")


def provider_consensus(scored: DataFrame) -> DataFrame:
    """One answer per plate from all of its records: best record, voted fields, consensus, confidence.

    `scored`: plate, record_id, source_label, and the fields of a scored record.
    """
    fields = [f for f in VOTED if f in scored.columns]
    # Records that differ in their id only are merged first: whatever follows reads one row for them, with the
    # first and the last of their ids, and none of it sorts a record once per field.
    told = ["plate", "source_label", "source_kind", "lookup_score", "is_official", "public_count", "sensitive_count"]
    named = F.struct("record_id")
    alike = scored.groupBy(*dict.fromkeys([*told, *fields])).agg(
        F.count(F.lit(1)).alias("_n"), F.min(named).alias("_first_id"), F.max(named).alias("_last_id")
    )
    alike = stash(alike, "provider-scores")

    def order(id_: str) -> Column:
        return F.struct(
            (-F.col("lookup_score")).alias("score"),
            (~F.col("is_official")).alias("unofficial"),
            (-F.col("public_count")).alias("public"),
            (-F.col("sensitive_count")).alias("sensitive"),
            F.col("source_label").alias("label"),
            F.col(f"{id_}.record_id").alias("id"),
        )

    # weight times count, exact: a weight has few digits before the point
    weight = F.greatest(F.lit(1.0), F.col("lookup_score") / 20.0).cast("decimal(20,12)")
    ranked = alike.withColumns(
        {"_order": order("_first_id"), "_late": order("_last_id"), "_weight": weight * F.col("_n").cast("decimal(17,0)")}
    )
    best = ranked.groupBy("plate").agg(
        F.sum("_n").alias("candidates_count"),
        F.min_by(F.struct("source_label", "source_kind", "lookup_score", *fields), "_order").alias("best"),
        # as many as there are providers
        F.size(F.collect_set(F.when(F.col("is_official"), F.col("source_label")))).alias("_official"),
    )
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.trim(F.col(f)).alias("value")) for f in fields])
    kept = ["plate", "_order", "_late", "_weight", "_n", "lookup_score"]
    cast = ranked.select(*kept, F.explode(pairs).alias("_f")).select(
        *kept, "_f.field", "_f.value", norm_upper(F.col("_f.value")).alias("norm")
    )
    votes = (
        cast.where(F.col("norm") != "")
        .groupBy("plate", "field", "norm")
        .agg(
            F.sum("_n").alias("n"),
            exact_sum(F.col("_weight")).alias("weight"),
            F.max("lookup_score").alias("top"),
            F.max_by("value", F.struct(F.col("lookup_score"), F.col("_late"))).alias("value"),
            F.min("_order").alias("first"),
        )
        .withColumn(
            "_place", F.struct((-F.col("weight")).alias("w"), (-F.col("n")).alias("c"), (-F.col("top")).alias("t"), "first")
        )
    )
    votes = stash(votes, "provider-votes")
    leading = Window.partitionBy("plate", "field").orderBy("_place")
    shown = F.struct("_r", F.concat(F.trim("value"), F.lit("x"), F.col("n").cast("string")).alias("s"))
    details = (
        votes.withColumn("_r", F.row_number().over(leading))
        .where(F.col("_r") <= 4)
        .groupBy("plate", "field")
        .agg(F.concat_ws(" | ", F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["s"])).alias("detail"))
    )
    fieldwise = votes.groupBy("plate", "field").agg(
        F.min_by(F.struct("value", "n", "weight"), "_place").alias("win"),
        F.count(F.lit(1)).alias("values"),
        exact_sum(F.col("weight")).alias("total"),
    )
    listed = (F.col("values") == 1) | (F.col("win.n") > 1)
    agreed = listed | (F.col("win.weight") / F.col("total") >= 0.66)
    per_field = fieldwise.join(details, ["plate", "field"]).select(
        "plate", "field", F.col("win.value").alias("value"), listed.alias("listed"), agreed.alias("agreed"),
        (F.col("values") > 1).alias("split"), "detail",
    )
    place = F.array_position(F.array(*[F.lit(f) for f in fields]), F.col("field"))

    def names(flag: str, what: str = "field", sep: str = ",") -> Column:
        items = F.array_sort(F.collect_list(F.when(F.col(flag), F.struct(place.alias("p"), F.col(what).alias("s")))))
        return F.concat_ws(sep, F.transform(items, lambda x: x["s"]))

    # At most one row per plate and voted field reaches this point, so the lists are short.
    by_plate = per_field.withColumn("_line", F.concat("field", F.lit(": "), "detail")).groupBy("plate").agg(
        F.count(F.lit(1)).alias("fields_considered"),
        F.count_if("agreed").alias("_agreed"),
        names("listed").alias("consensus_fields"),
        names("split").alias("divergent_fields"),
        names("split", "_line", "; ").alias("divergent_details"),
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"_win_{f}") for f in fields],
    )
    joined = best.join(by_plate, "plate", "left")
    share = F.coalesce(rnd(F.col("_agreed") / F.col("fields_considered") * 100.0, 1), F.lit(0.0))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    resolved = [
        F.when(blank(F.col(f"best.{f}")), F.coalesce(f"_win_{f}", F.col("plate") if f == "placa" else F.lit("")))
        .otherwise(F.col(f"best.{f}"))
        .alias(f)
        for f in fields
        if f not in SENSITIVE
    ]
    return joined.select(
        "plate",
        F.when(F.col("candidates_count") > 1, "multifonte").otherwise("unifonte").alias("status"),
        "candidates_count",
        F.coalesce("_official", F.lit(0)).cast("bigint").alias("official_candidates"),
        F.col("best.source_label").alias("best_source_label"),
        F.col("best.source_kind").alias("best_source_kind"),
        F.col("best.lookup_score").alias("best_score"),
        share.alias("consensus_ratio"),
        rnd(F.least(F.lit(100.0), F.col("best.lookup_score") * 0.7 + share * 0.3), 1).alias("confidence"),
        F.coalesce("consensus_fields", F.lit("")).alias("consensus_fields"),
        F.coalesce("divergent_fields", F.lit("")).alias("divergent_fields"),
        F.coalesce("divergent_details", F.lit("")).alias("divergent_details"),
        *resolved,
    )
