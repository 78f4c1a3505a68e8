"""Open-web evidence over a table of pages: trust, page scores, confirmation by domain."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from vestigo.functions.numbers import clamp, rnd
from vestigo.functions.text import host_of, norm_upper, years_in
from vestigo.operators.spread import settle
from vestigo.session import stash

# Trust of makers' own domains and of specialist ones.
BRAND_TRUST, FORUM_TRUST = 5.0, 2.8
BRAND_DOMAINS = [
    "fiat.com.br", "fiat.com",
    "chevrolet.com.br", "chevrolet.com",
    "vw.com.br", "volkswagen.com.br", "volkswagen.com",
    "hyundai.com.br", "hyundai.com",
    "renault.com.br", "renault.com",
    "ford.com.br", "ford.com",
    "honda.com.br", "honda.com",
    "yamaha-motor.com.br", "yamaha-motor.com",
    "suzukimotos.com.br", "suzuki.com",
    "kawasakibrasil.com", "kawasaki.com",
    "bmw-motorrad.com.br", "bmw.com",
    "scania.com", "scania.com.br",
    "volvo.com", "volvotrucks.com",
    "mercedes-benz.com.br", "mercedes-benz.com",
    "iveco.com.br", "iveco.com",
    "daf.com", "dafcaminhoes.com.br",
]
SPECIALIST_DOMAINS = {
    "quatrorodas.abril.com.br": 4.4,
    "webmotors.com.br": 4.2,
    "icarros.com.br": 3.8,
    "autopapo.uol.com.br": 3.8,
    "motor1.uol.com.br": 3.8,
    "carrosnaweb.com.br": 3.8,
    "revistaautoesporte.globo.com": 3.7,
    "motoo.com.br": 3.8,
    "motonline.com.br": 3.6,
    "motonline.uol.com.br": 3.5,
    "caminhoes-e-carretas.com": 3.8,
    "blogdocaminhoneiro.com": 3.7,
    "estradao.estadao.com.br": 3.7,
    "autoline.com.br": 3.1,
    "car.blog.br": 3.5,
    "flatout.com.br": 3.5,
    "olx.com.br": 2.4,
    "mercadolivre.com.br": 2.2,
    "amazon.com.br": 2.0,
}
FORUM_WORDS = ("forum", "clube", "club")
# Words of specialist pages, words of vehicle categories, words of components.
SPECIALIST_WORDS = (
    "FICHA TECNICA", "TESTE", "AVALIACAO", "FAROIS", "LANTERNA", "GRADE", "CATALOGO", "MANUAL DO PROPRIETARIO",
)
CATEGORY_WORDS = {
    "AUTOMOVEL": ("CARRO", "AUTOMOVEL", "HATCH", "SEDAN", "SUV", "PICAPE"),
    "MOTOCICLETA": ("MOTO", "MOTOCICLETA", "SCOOTER", "NAKED", "TRAIL"),
    "CAMINHAO": ("CAMINHAO", "TRUCK", "CARRETA", "CAVALO MECANICO", "RODOTREM"),
}
COMPONENT_TERMS = {
    "emblema_frontal": "emblema frontal logotipo grade",
    "grade_dianteira": "grade dianteira desenho frontal",
    "farois_dianteiros": "farol dianteiro assinatura optica",
    "lanternas_traseiras": "lanterna traseira assinatura lente",
    "parachoque": "parachoque dianteiro traseiro desenho",
    "retrovisores": "retrovisor externo posicao estilo",
    "rodas_originais": "rodas originais aro acabamento",
    "entradas_ar_frisos": "entradas de ar frisos laterais",
    "linhas_portas": "perfil lateral portas vincos",
    "capo_dianteiro": "capo dianteiro vincos recorte",
    "tampa_traseira": "tampa traseira recorte placa",
    "design_carroceria": "design carroceria hatch sedan",
}
CATEGORY_TERMS = {
    "AUTOMOVEL": {},
    "MOTOCICLETA": {
        "tanque_carenagem": "tanque carenagem lateral moto",
        "rabeta_lanterna": "rabeta e lanterna traseira motocicleta",
        "escapamento": "escapamento ponteira acabamento moto",
        "garfo_dianteiro": "garfo dianteiro e suspensao moto",
    },
    "CAMINHAO": {
        "cabine": "cabine frontal caminhao desenho",
        "conjunto_optico": "farol dianteiro caminhao assinatura",
        "eixos_rodado": "quantidade de eixos e rodado",
        "implemento_traseiro": "implemento traseiro bau carroceria",
    },
}
# Page and confirmation scores.
PAGE_CAP = 14
# Thousandths for a year in range, and the first year that counts.
YEAR_POINTS, FIRST_YEAR = 1600, 1900
#: Categories with terms of their own, and all others.
KINDS = ("", *CATEGORY_TERMS)
# Most pages and candidates that meet in one task, and how many of them are compared at a time.
PAGE_BLOCK, CANDIDATE_BLOCK = 4_096, 16_384
PAGE_CHUNK, CANDIDATE_CHUNK = 512, 1_024
CONFIRM_FLOOR, CONFLICT_FLOOR, CATEGORY_BONUS = 7.2, 7.0, 0.8


def trust_weight(domain: Column, extra: dict[str, float] | None = None) -> Column:
    """Trust of a domain by its longest-lived suffix: maker, specialist, forum, or none."""
    table = {d: BRAND_TRUST for d in BRAND_DOMAINS} | SPECIALIST_DOMAINS | (extra or {})
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    parts = F.split(domain, "\\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
    )
    best = F.array_max(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(known, s), F.lit(0.0))))
    forum = F.lit(False)
    for word in FORUM_WORDS:
        forum = forum | domain.contains(word)
    return F.when(domain == "", 0.0).when(best > 0, best).when(forum, FORUM_TRUST).otherwise(0.0)


def _any_word(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def page_dedupe_and_filter(pages: DataFrame, extra_trust: dict[str, float] | None = None) -> DataFrame:
    """First page per URL; only trusted domains and pages that read like specialist ones stay.

    `pages`: page_id, url, title, snippet, component_hint.
    """
    first = (
        pages.where(F.trim("url") != "")
        .groupBy(F.trim("url").alias("url"))
        .agg(F.min_by(F.struct("page_id", "title", "snippet", "component_hint"), "page_id").alias("p"))
        .select("url", "p.*")
    )
    domain = host_of(F.col("url"))
    marked = first.withColumn("domain", domain).withColumn("trust", trust_weight(F.col("domain"), extra_trust))
    told = norm_upper(F.concat_ws(" ", "title", "snippet"))
    return marked.where((F.col("trust") > 0) | _any_word(told, SPECIALIST_WORDS))


def _page_text() -> Column:
    return norm_upper(F.concat_ws(" ", "title", "snippet", "url"))


def _hinted(category: Column, text: Column) -> Column:
    """Points for the terms of the page's component that its text shows; some count for one category only."""
    terms = F.lit("")
    for name, line in COMPONENT_TERMS.items():
        terms = F.when(F.col("component_hint") == name, norm_upper(F.lit(line))).otherwise(terms)
    for kind, lines in CATEGORY_TERMS.items():
        for name, line in lines.items():
            terms = F.when((category == kind) & (F.col("component_hint") == name), norm_upper(F.lit(line))).otherwise(terms)
    return F.size(F.filter(F.split(terms, " "), lambda t: (t != "") & text.contains(t))) * 0.8


class _Names:
    """Which of some names the texts show; words and names are upper case, parted by single blanks.

    A name of one word shows where it is part of a word, so each distinct word is looked up once.
    """

    def __init__(self, names: list[str]):
        plain = dict.fromkeys(n for n in names if n and " " not in n)
        wide = [n for n in dict.fromkeys(names) if " " in n]
        self.number = {n: i for i, n in enumerate(dict.fromkeys([*plain, *(n.split(" ")[0] for n in wide)]), 1)}
        self._lengths = sorted({len(n) for n in self.number})
        self._wide = [(n, self.number[n.split(" ")[0]]) for n in wide]
        self._inside: dict[str, list[int]] = {}
        single = dict(self.number)
        self._single = single
        self.number = single | {n: len(single) + 1 + i for i, (n, _) in enumerate(self._wide)} | {"": 0}

    def _in_word(self, word: str) -> list[int]:
        found = self._inside.get(word)
        if found is None:
            parts = {word[i : i + n] for n in self._lengths if n <= len(word) for i in range(len(word) - n + 1)}
            found = self._inside[word] = [self._single[p] for p in parts if p in self._single]
        return found

    def shown(self, texts: list[str]) -> np.ndarray:
        """Names by number (0 is the empty one, never shown) x texts."""
        out = np.zeros((len(self.number), len(texts)), bool)
        for at, text in enumerate(texts):
            out[list({n for word in set(text.split(" ")) for n in self._in_word(word)}), at] = True
        for i, (name, head) in enumerate(self._wide, len(self._single) + 1):
            for at in np.flatnonzero(out[head]):
                out[i, at] = name in texts[at]
        return out


def _best_pages(wanted: pd.DataFrame, pages: pd.DataFrame, cap: int) -> pd.DataFrame:
    """The `cap` best pages of a block for each candidate of another, of equal scores the smaller page_id.

    Scores are whole thousandths. Pages are read in chunks by rising id, and only the best so far are held
    beside a chunk's scores; a score and the page's place make one number, so that the larger is the better.
    """
    if wanted.empty or pages.empty:
        return pd.DataFrame({n: [] for n in ("candidate_id", "maker", "model", "page_id", "domain", "score")})
    pages = pages.sort_values("page_id", kind="stable").reset_index(drop=True)
    makers, models = wanted["maker"].tolist(), wanted["model"].tolist()
    parts = {i: [t for t in m.split(" ") if len(t) > 1] for i, m in enumerate(models) if " " in m}
    names = _Names([*makers, *models, *(t for ts in parts.values() for t in ts)])
    maker, model = (np.array([names.number[n] for n in side], int) for side in (makers, models))
    parts = {i: [names.number[t] for t in ts] for i, ts in parts.items()}
    kind = np.array([KINDS.index(c) if c in CATEGORY_TERMS else 0 for c in wanted["category"]])
    ends = wanted[["low", "high"]].fillna(0).to_numpy(int)
    spans, span = np.unique(ends, axis=0, return_inverse=True)
    span, hinted = span.ravel(), spans[:, 0] > 0
    spans = np.where(spans > 0, spans - FIRST_YEAR, 0)
    step = len(pages) + 1
    best = np.full((len(wanted), cap), np.iinfo(np.int64).min // 2)
    for at in range(0, len(pages), PAGE_CHUNK):
        some = pages.iloc[at : at + PAGE_CHUNK]
        shown = names.shown(some["text"].tolist())
        base = np.stack(some["bases"].to_numpy()).T
        upto = np.zeros((202, len(some)), np.int16)
        for i, years in enumerate(some["years"]):
            upto[np.asarray(years, int) - FIRST_YEAR + 1, i] = 1
        upto = np.cumsum(upto, axis=0, dtype=np.int16)
        dated = (upto[spans[:, 1] + 1] > upto[spans[:, 0]]) & hinted[:, None]
        place = at + np.arange(len(some))
        for first in range(0, len(wanted), CANDIDATE_CHUNK):
            c = slice(first, first + CANDIDATE_CHUNK)
            score = base[kind[c]] + 4000 * shown[maker[c]] + 6000 * shown[model[c]] + YEAR_POINTS * dated[span[c]]
            for i in range(first, min(first + CANDIDATE_CHUNK, len(wanted))):
                if i in parts:
                    tokens = np.zeros(len(some), int)
                    for n in parts[i]:
                        tokens += shown[n]
                    score[i - first] += np.where(shown[model[i]], 0, 1400 * tokens)
            key = score * step - place
            rows = np.flatnonzero((key > best[c].min(axis=1)[:, None]).any(axis=1))
            met = np.hstack([best[c][rows], key[rows]])
            best[first + rows] = np.partition(met, met.shape[1] - cap, axis=1)[:, met.shape[1] - cap :]
    who, slot = np.nonzero(best > np.iinfo(np.int64).min // 2)
    key = best[who, slot]
    where = -key % step
    return pd.DataFrame(
        {
            "candidate_id": wanted["candidate_id"].to_numpy()[who],
            "maker": wanted["maker"].to_numpy()[who],
            "model": wanted["model"].to_numpy()[who],
            "page_id": pages["page_id"].to_numpy()[where],
            "domain": pages["domain"].to_numpy()[where],
            "score": (key + where) // step / 1000.0,
        }
    )


def score_pages(
    candidates: DataFrame, pages: DataFrame, cap: int = PAGE_CAP, page_block: int = PAGE_BLOCK, candidate_block: int = CANDIDATE_BLOCK
) -> DataFrame:
    """Best pages for each candidate, which is scored against every page.

    Pages and candidates fall into blocks of bounded size. Each block meets each in one task, which looks
    every word of its pages up among the names of its candidates, and of which only the best pages per
    candidate leave; neither side passes through the driver. `candidates`: candidate_id, maker, model,
    category, year_hint. The text is brought back for the winners.
    """
    # Cleaning a page, finding its years and its terms is done once, not for each pair.
    read = settle(pages.select("page_id", "domain", "trust", "component_hint", _page_text().alias("text")), "text")
    base = lambda kind: F.round(rnd(F.col("trust") + _hinted(F.lit(kind), F.col("text")), 3) * 1000).cast("bigint")
    told = read.select("page_id", "domain", "text", F.array_distinct(years_in(F.col("text"))).alias("years"), F.array(*[base(k) for k in KINDS]).alias("bases"))
    told = stash(told.where(F.col("page_id").isNotNull()), "told-pages")
    years = years_in(F.coalesce("year_hint", F.lit("")))
    wanted = candidates.where(F.col("candidate_id").isNotNull()).select(
        "candidate_id", norm_upper(F.col("maker")).alias("maker"), norm_upper(F.col("model")).alias("model"), "category",
        F.array_min(years).alias("low"), F.array_max(years).alias("high"),
    )
    wanted = stash(wanted, "wanted-pages")
    sides = max(1, -(-wanted.count() // candidate_block)), max(1, -(-told.count() // page_block))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = wanted.select("*", part("candidate_id", sides[0]).alias("b"), every(sides[1]).alias("s"))
    right = told.select("*", part("page_id", sides[1]).alias("s"), every(sides[0]).alias("b"))
    kept = [wanted.schema[n] for n in ("candidate_id", "maker", "model")] + [told.schema[n] for n in ("page_id", "domain")]
    scored = left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInPandas(
        lambda w, p: _best_pages(w, p, cap), T.StructType([*kept, T.StructField("score", T.DoubleType())])
    )
    best = Window.partitionBy("candidate_id").orderBy(F.col("score").desc(), "page_id")
    top = scored.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= cap)
    # Texts are far larger read than stored, so they are shuffled, not sent whole by the size of their files.
    return top.join(told.select("page_id", "text").hint("merge"), "page_id")


def web_confirmation(candidates: DataFrame, scored: DataFrame) -> DataFrame:
    """Independent domains that confirm or contradict each candidate, and the confidence that follows.

    `candidates`: candidate_id, maker, model, category; the siblings of a model are the other models
    of its maker among the candidates. `scored`: output of score_pages.
    """
    names = candidates.select(
        "candidate_id", norm_upper(F.col("maker")).alias("maker"), norm_upper(F.col("model")).alias("model"), "category"
    )
    # The models of one maker are a catalogue entry, not data that grows.
    siblings = names.groupBy("maker").agg(F.collect_set("model").alias("models"))
    paged = scored.select("candidate_id", "domain", "score", "text").where(F.col("domain") != "")
    # Met last: no candidate is moved with all the models of its maker.
    joined = paged.join(names, "candidate_id").join(siblings, "maker", "left")
    text, model = F.col("text"), F.col("model")
    has_maker = (F.col("maker") != "") & text.contains(F.col("maker"))
    has_model = (model != "") & text.contains(model)
    topical = F.lit(False)
    for name, words in CATEGORY_WORDS.items():
        topical = F.when(F.col("category") == name, _any_word(text, words)).otherwise(topical)
    page = F.col("score") + F.when(topical, CATEGORY_BONUS).otherwise(0.0)
    rival = F.exists("models", lambda m: (m != "") & (m != model) & text.contains(m))
    by_domain = joined.groupBy("candidate_id", "domain").agg(
        F.max(F.when(has_maker & has_model & (page >= CONFIRM_FLOOR), page)).alias("confirm"),
        F.max(F.when(has_maker & ~has_model & rival & (page >= CONFLICT_FLOOR), page)).alias("conflict"),
        F.count_if(topical).alias("topical"),
    )
    rolled = by_domain.groupBy("candidate_id").agg(
        F.count("confirm").alias("_n"),
        F.count("conflict").alias("_c"),
        F.avg(F.col("confirm").cast("decimal(28,12)")).cast("double").alias("_nm"),
        F.avg(F.col("conflict").cast("decimal(28,12)")).cast("double").alias("_cm"),
        F.sum("topical").alias("_t"),
        F.array_sort(F.collect_set(F.when(F.col("confirm").isNotNull(), F.col("domain")))).alias("_domains"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    score = (
        zero("_n") * 16.0
        + zero("_nm").cast("double") * 5.2
        + F.least(F.lit(4), zero("_t")) * 2.2
        - (zero("_c") * 9.5 + zero("_cm").cast("double") * 2.8)
    )
    reasons = F.array_compact(
        F.array(
            F.when(zero("_n") == 0, "sem_confirmacao_independente_em_fontes_abertas"),
            F.when(zero("_c") > 0, "fontes_apontam_modelos_semelhantes_em_conflito"),
            F.when(zero("_t") == 0, "fontes_sem_contexto_claro_de_categoria_veicular"),
        )
    )
    return names.join(rolled, "candidate_id", "left").select(
        "candidate_id",
        rnd(clamp(score, 0.0, 99.0), 2).alias("web_score"),
        zero("_n").cast("bigint").alias("confirmation_count"),
        zero("_c").cast("bigint").alias("conflict_count"),
        zero("_t").cast("bigint").alias("category_support"),
        F.concat_ws(",", "_domains").alias("confirmation_domains"),
        F.concat_ws(",", reasons).alias("reasons"),
    )
