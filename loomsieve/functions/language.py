"""Language and code heuristics as Columns.

Non-Latin scripts are told by their share of letters, Latin ones by the distinct
function words that occur. Confidence is the share, or (best - second) / best.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsieve.functions.text import words

CODE_MARKS = (
    "function class import return const let var def public private static void int string async await try catch throw => -> :: == != && || ++ --".split()
)
CODE_LEAST = 3

#: ISO 639-3 and 639-1 codes; zh and no name the larger variety.
LANGUAGES = {
    "eng": "en", "spa": "es", "fra": "fr", "deu": "de", "por": "pt", "rus": "ru", "jpn": "ja", "cmn": "zh", "ara": "ar", "hin": "hi",
    "ita": "it", "nld": "nl", "pol": "pl", "tur": "tr", "vie": "vi", "kor": "ko", "swe": "sv", "dan": "da", "fin": "fi", "nob": "no",
}
ALIASES = {"zho": "cmn", "nor": "nob"}

FUNCTION_WORDS = {
    "eng": "the of and to in is that it was for on are with as be at by this have from or an not but they you which his her were had what there been their all would will can",
    "fra": "le la les de des du et un une en que qui est dans pour pas par sur au aux avec ce cette il elle ne se son sa ou mais nous vous sont était",
    "deu": "der die das und den dem des ein eine einen ist nicht mit von zu auf für sich im auch als an es wird sind er sie bei oder aus nach wie über war",
    "spa": "el la los las de del que y en un una es por con para no se su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin",
    "por": "o os as de do da dos das que e em um uma é por com para não se ao como mais mas foi ele ela seu sua ou quando muito nos já está",
    "ita": "il lo la gli le di del della che e in un una è per con non si al come più ma sono era anche questo alla dei nel suo ha da",
    "nld": "de het een en van in is dat op te zijn met voor niet aan er om ook als dan maar bij nog uit door naar hij ze wordt was",
    "swe": "och att det som en på är av för med till den har de inte om ett han men var jag sig från så kan när hon under också",
    "dan": "og at det som en på er af for med til den har de ikke om et han men var jeg sig fra så kan når hun efter også",
    "nob": "og at det som en på er av for med til den har de ikke om et han men var jeg seg fra så kan når hun etter også",
    "fin": "ja on ei se että oli hän joka mutta kun ovat niin myös kuin tai sen jos vain ole hänen sitä mitä olla sekä",
    "pol": "i w na z do się nie to jest że o jak po co ale za od przez dla są tak być jego był który przy może",
    "tur": "ve bir bu da de için ile çok olarak gibi daha olan ne kadar sonra en ama var o değil ki mi her",
    "vie": "và của là có trong cho không được một các với những người này đã để từ khi đến về như tại",
}
#: Java class, RE2 class
SCRIPTS = {
    "rus": (r"\p{IsCyrillic}", r"\p{Cyrillic}"),
    "cmn": (r"\p{IsHan}", r"\p{Han}"),
    "jpn": (r"\p{IsHiragana}\p{IsKatakana}", r"\p{Hiragana}\p{Katakana}"),
    "kor": (r"\p{IsHangul}", r"\p{Hangul}"),
    "ara": (r"\p{IsArabic}", r"\p{Arabic}"),
    "hin": (r"\p{IsDevanagari}", r"\p{Devanagari}"),
}


def parse_code(code: str) -> str:
    """ISO 639-3 code of a known language, in either case; else ValueError."""
    c = code.lower()
    c = ALIASES.get(c, c)
    for three, two in LANGUAGES.items():
        if c in (three, two):
            return three
    raise ValueError(f"unsupported language code: {code}")


@dataclass(frozen=True)
class LanguageConfig:
    """``code`` among the languages is accepted and changes nothing: code always passes."""

    allowed_languages: tuple[str, ...] = ("eng",)
    confidence_threshold: float = 0.5
    min_text_length: int = 50

    def __post_init__(self) -> None:
        if not self.allowed_languages:
            raise ValueError("at least one language is needed")
        if not 0 <= self.confidence_threshold <= 1:
            raise ValueError("confidence_threshold must lie in 0..1")
        self.allowed()

    def allowed(self) -> list[str]:
        return [parse_code(c) for c in self.allowed_languages if c.lower() != "code"]

    @classmethod
    def english_only(cls) -> LanguageConfig:
        return cls()

    @classmethod
    def english_with_code(cls) -> LanguageConfig:
        return cls(confidence_threshold=0.3)

    @classmethod
    def multilingual(cls) -> LanguageConfig:
        return cls(("eng", "spa", "fra", "deu", "por", "rus", "jpn", "zho", "ara", "hin"))


def looks_like_code(c: Column) -> Column:
    """At least three of the marks occur anywhere in the lower-cased text, inside words too."""
    return _marked(F.lower(c))


def _marked(low: Column) -> Column:
    hits = sum((low.contains(m).cast("int") for m in CODE_MARKS), F.lit(0))
    return F.coalesce(hits >= CODE_LEAST, F.lit(False))


def with_language(df: DataFrame, field: str, tokens: str | None = None) -> DataFrame:
    """Adds detected_lang (null: none) and confidence. ``tokens`` names a column of the text's words."""
    c = F.coalesce(F.col(field), F.lit(""))
    count = lambda cls: F.char_length(F.regexp_replace(c, f"[^{cls}]", ""))
    out = df.withColumns({"__letters": count(r"\p{L}"), "__latin": count(r"\p{IsLatin}")})
    known = F.array(*[F.lit(x) for x in sorted({x for v in FUNCTION_WORDS.values() for x in v.split()})])  # languages look at these few only
    out = out.select("*", F.explode(F.array(F.array_intersect(F.col(tokens) if tokens else words(c), known))).alias("__w"))
    plain = F.col("__latin") >= F.col("__letters")  # saves six passes over a wholly Latin text
    out = out.withColumns({f"__{k}": F.when(plain, 0).otherwise(count(java)) for k, (java, _) in SCRIPTS.items()})
    kana = F.when(F.col("__jpn") > 0, F.col("__jpn") + F.col("__cmn")).otherwise(0)
    han = F.when(F.col("__jpn") > 0, 0).otherwise(F.col("__cmn"))
    shares = {k: {"jpn": kana, "cmn": han}.get(k, F.col(f"__{k}")) / F.greatest(F.col("__letters"), F.lit(1)) for k in SCRIPTS}
    hits = {k: F.size(F.array_intersect("__w", F.array(*[F.lit(x) for x in v.split()]))) for k, v in FUNCTION_WORDS.items()}
    ranked = F.array(*[F.struct(n.alias("n"), F.lit(-i).alias("r"), F.lit(k).alias("k")) for i, (k, n) in enumerate(hits.items())])
    out = out.withColumn("__scripts", F.array(*[F.struct(v.alias("n"), F.lit(k).alias("k")) for k, v in shares.items()]))
    found = F.struct(F.array_max("__scripts").alias("__s"), F.sort_array(ranked, asc=False).alias("__r"))
    out = out.select("*", F.inline(F.array(found)))
    best, second = F.col("__r")[0]["n"], F.col("__r")[1]["n"]
    script = F.col("__s")["n"] >= 0.5
    return out.withColumns(
        {
            "detected_lang": F.when(script, F.col("__s")["k"]).when(best > 0, F.col("__r")[0]["k"]),
            "confidence": F.when(script, F.round(F.col("__s")["n"], 6)).when(best > 0, F.round((best - second) / best, 6)).otherwise(0.0),
        }
    ).drop("__letters", "__latin", "__w", "__scripts", "__s", "__r", *[f"__{k}" for k in SCRIPTS])


def with_acceptance(df: DataFrame, field: str, cfg: LanguageConfig, tokens: str | None = None) -> DataFrame:
    """Adds short, is_code, detected_lang, confidence and accepted. A null text counts as empty."""
    c = F.coalesce(F.col(field), F.lit(""))
    out = with_language(df, field, tokens).select("*", F.explode(F.array(F.lower(c))).alias("__low"))  # lowered once, not for each mark
    out = out.withColumns({"short": F.octet_length(c) < cfg.min_text_length, "is_code": _marked(F.col("__low"))}).drop("__low")
    known = F.coalesce(F.col("detected_lang").isin(cfg.allowed()) & (F.col("confidence") >= cfg.confidence_threshold), F.lit(False))
    return out.withColumn("accepted", F.col("short") | F.col("is_code") | known)


def stats(judged: DataFrame) -> DataFrame:
    """One row of counts and rates over the total."""
    rest = ~F.col("short") & ~F.col("is_code")
    seen = rest & F.col("detected_lang").isNotNull()
    out = judged.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("short").alias("skipped_short"),
        F.count_if(~F.col("short") & F.col("is_code")).alias("code_detected"),
        F.count_if(seen & F.col("accepted")).alias("accepted"),
        F.count_if(seen & ~F.col("accepted")).alias("rejected"),
        F.count_if(rest & F.col("detected_lang").isNull()).alias("detection_failed"),
    )
    rate = lambda c: F.when(F.col("total") > 0, F.round(F.col(c) / F.col("total"), 6)).otherwise(0.0)
    return out.withColumns({"acceptance_rate": rate("accepted"), "rejection_rate": rate("rejected")})


def distribution(judged: DataFrame) -> DataFrame:
    seen = judged.where(~F.col("short") & ~F.col("is_code") & F.col("detected_lang").isNotNull())
    return seen.groupBy("detected_lang").agg(F.count(F.lit(1)).alias("n"))
