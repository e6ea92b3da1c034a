"""Roles: steps with dependencies and failure policies, run as columns in one plan; evidence checks; event rules; evaluation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import texts

#: What an error or missing evidence makes of an outcome, by policy.
FAILED = {"closed": "rejected", "review": "review", "preserve": "degraded"}


@dataclass(frozen=True)
class Role:
    """output is a struct column (value, quote) over the article's columns and those of the roles it depends on."""

    name: str
    output: Callable[[], Column]
    policy: str = "closed"
    needs_evidence: bool = True
    after: tuple[str, ...] = field(default=())


def idempotency_key(role: str, article_id: Column, title: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", F.lit(role), article_id.cast("string"), title, text), 256), 1, 32)


def envelope(role: Role) -> Callable[[Column], Column]:
    """What makes a role's struct of what it puts out."""
    def told(out: Column) -> Column:
        source = F.concat_ws("\n", "title", "text")
        fine = texts.grounded(F.coalesce(out["quote"], F.lit("")), source) if role.needs_evidence else F.lit(True)
        stopped = F.lit(False)
        for before in role.after:
            stopped = stopped | F.col(before)["outcome"].isin("rejected", "skipped")
        outcome = F.when(stopped, "skipped").when(out["value"].isNull() | ~fine, FAILED[role.policy]).otherwise("accepted")
        key = idempotency_key(role.name, F.col("article_id"), F.col("title"), F.col("text"))
        return F.struct(outcome.alias("outcome"), out["value"].alias("value"), F.when(fine, out["quote"]).alias("quote"), key.alias("key"))

    return told


def run_roles(articles: DataFrame, roles: list[Role]) -> DataFrame:
    """articles with a struct column per role: outcome, value, quote, key. A quote has to stand in the title or text.

    Roles run in order of their dependencies; one after a role that was rejected is skipped. All are expressions over the
    row, so that the whole graph runs without a shuffle. What a role puts out and its outcome are computed once, however often they and later roles name them.
    """
    by = {r.name: r for r in roles}
    for name in TopologicalSorter({r.name: set(r.after) for r in roles}).static_order():
        articles = articles.withColumn(name, texts.bound(by[name].output(), envelope(by[name])))
    return articles


def valid_evidence(items: DataFrame, articles: DataFrame, requirements: DataFrame) -> DataFrame:
    """items with score after checks: 0 without a literal quote, 2.5 where a full item lacks required fields in its quote.

    items: article_id, direction, dimension, score, quote, fields map<string,string>; requirements: direction, dimension,
    required array<string>, one_of array<string>. A field counts if its value stands in the quote, punctuation aside.
    """
    joined = items.join(articles.select("article_id", "title", "text"), "article_id").join(F.broadcast(requirements), ["direction", "dimension"])
    quote = texts.plain(F.col("quote"))
    told = lambda name: F.coalesce((texts.plain(F.try_element_at("fields", name)) != "") & quote.contains(texts.plain(F.try_element_at("fields", name))), F.lit(False))
    literal = texts.grounded(F.col("quote"), F.concat_ws("\n", "title", "text"))
    whole = F.forall("required", told) & ((F.size("one_of") == 0) | F.exists("one_of", told))
    score = F.when(~F.coalesce(literal, F.lit(False)), 0.0).when((F.col("score") >= 5) & ~whole, 2.5).otherwise(F.col("score"))
    return joined.select("article_id", "direction", "dimension", score.alias("score"), F.when(score > 0, F.col("quote")).alias("quote"))


def combined(given: DataFrame, rules: DataFrame) -> DataFrame:
    """Scores from outside with rule scores where they are zero or missing, and those at most 2.5."""
    a, b = given.select("article_id", "direction", "dimension", F.col("score").alias("given")), rules.select("article_id", "direction", "dimension", F.col("score").alias("rule"))
    both = a.join(b, ["article_id", "direction", "dimension"], "full")
    score = F.when(F.coalesce("given", F.lit(0.0)) > 0, F.col("given")).otherwise(F.least(F.coalesce("rule", F.lit(0.0)), F.lit(2.5)))
    return both.select("article_id", "direction", "dimension", score.alias("score"))


#: Rules for kinds of events in order, the first that holds counts; names of organisations beside capitalised words.
EVENTS = [
    ("release", r"(?i)release|launch|上线|发布|推出|开源"),
    ("funding", r"(?i)funding|series\s*[a-f]|融资|估值|投资"),
    ("acquisition", r"(?i)acqui(?:re|sition)|并购|收购"),
    ("benchmark", r"(?i)benchmark|leaderboard|mmlu|swe[-_ ]?bench|评测|基准"),
    ("policy", r"(?i)policy|regulation|governance|政策|监管|治理"),
    ("partnership", r"(?i)partnership|partner|contract|合作|签约|合同"),
    ("research", r"(?i)paper|study|研究|论文|报告"),
]
ENTITY = r"OpenAI|Anthropic|Google|Microsoft|Meta|NVIDIA|Amazon|阿里|腾讯|百度|字节|英伟达|谷歌|微软|苹果|[A-Z][A-Za-z0-9_-]{2,}"
FEATURED, KEPT = ("来源", "，内容完整度", "分，事件证据已复核。"), "未满足精选条件，保留在工作台供人工复核。"


def event_kind(title: Column, text: Column) -> Column:
    return F.coalesce(texts.first_rule(F.concat_ws("\n", title, text), [(k, texts.caseless(p.removeprefix("(?i)"))) for k, p in EVENTS]), F.lit("other"))


def recognized(title: Column, text: Column) -> Column:
    """struct(kind, entities, event_key, confidence): the first twelve different names, sorted; the key tells events apart."""
    kind = event_kind(title, text)
    entities = F.array_sort(F.slice(F.array_distinct(F.regexp_extract_all(F.concat_ws("\n", title, text), F.lit(f"({ENTITY})"), F.lit(1))), 1, 12))
    key = F.substring(F.sha2(F.concat_ws("\n", kind, F.array_join(entities, "|"), title), 256), 1, 24)
    return F.struct(kind.alias("kind"), entities.alias("entities"), key.alias("event_key"), F.when(kind == "other", 0.25).otherwise(0.75).alias("confidence"))


def anchored(title: Column, event: Column) -> Column:
    """struct(cluster_key, terms, comparable): the first twelve terms in order of title and entities name an event's cluster."""
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", title, F.array_join(event["entities"], " "))), F.lit(r"([\p{L}\p{N}][\p{L}\p{N}_-]*)"), F.lit(1))
    terms = F.slice(F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2))), 1, 12)
    key = F.concat(F.lit("evt_"), F.substring(F.sha2(F.concat_ws("\n", event["kind"], F.array_join(terms, "|")), 256), 1, 24))
    return F.struct(key.alias("cluster_key"), terms.alias("terms"), (F.size(terms) >= 2).alias("comparable"))


def event_review(event: Column, cluster: Column) -> Column:
    """struct(decision, reason): an event without a kind or comparable terms waits for a review."""
    said = lambda decision, reason: F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))
    return F.when(event["kind"] == "other", said("review", "missing_event")).when(~cluster["comparable"] | (event["confidence"] < 0.5), said("review", "weak_signal")).otherwise(said("approve", "consistent"))


def explained(source_name: Column, passes: Column, score: Column, review: Column) -> Column:
    """struct(featured, explanation): what passes its evaluation with an approved event is featured."""
    featured = passes & (review["decision"] == "approve")
    source = F.when(F.coalesce(source_name, F.lit("")) != "", F.concat(F.lit("「"), source_name, F.lit("」"))).otherwise("")
    return F.struct(featured.alias("featured"), F.when(featured, F.concat(F.lit(FEATURED[0]), source, F.lit(FEATURED[1]), score.cast("string"), F.lit(FEATURED[2]))).otherwise(KEPT).alias("explanation"))


#: What tells of the topic, of news, of effects, of details that can be checked; what denies, reports hearsay, looks ahead, praises.
WORDS = {
    "topic": (r"artificial intelligence|generative ai|machine learning|large language model|language model|foundation model|LLM|GPT|Claude|Gemini|Llama|Qwen|DeepSeek|Mistral|Gemma|Kimi|AI agents?|multimodal|model training|model inference|transformer", r"人工智能|生成式\s*AI|机器学习|深度学习|大模型|语言模型|基础模型|智能体|多智能体|多模态|模型训练|模型推理|神经网络"),
    "novelty": (r"launch(?:es|ed)?|release[ds]?|introduc(?:e[ds]?|ing)|debut(?:s|ed)?|open[- ]?source[ds]?|new|novel|first", "发布|推出|上线|开源|首次|首个|新型|新方法"),
    "impact": (r"available|deploy(?:ed|ment)?|adopt(?:ed|ion)?|production|users?|customers?|developers?|api|benchmark|accuracy|performance|latency|throughput|funding|acquisition|regulation|policy", "可用|部署|落地|采用|用户|开发者|接口|基准|性能|准确率|延迟|吞吐|融资|收购|政策|监管"),
    "detail": (r"benchmark|dataset|methodology|evaluation|results?|study|paper|report|api|[0-9]+(?:\.[0-9]+)?\s*(?:x|ms|s|seconds?|minutes?|hours?|days?|users?|tokens?|parameters?|billion|million|GB|TB)?", "数据集|方法|评测|基准|结果|论文|报告|接口"),
    "negation": (r"not|no|never|cannot|can't|failed to|fails? to|did not|does not|won't|without", "并未|未能|没有|不会|无法|否认|失败|未达到"),
    "rumour": (r"rumou?r|alleged(?:ly)?|unconfirmed|sources? say|people familiar|may have|could have", "传闻|据传|传言|消息人士|尚未证实|未经证实|或已|可能已"),
    "future": (r"will|plans? to|aims? to|intends? to|expected to|upcoming|roadmap|would|could|may", "将于|将在|计划|拟于|预计划|有望|未来|将会|拟将"),
    "marketing": (r"revolutionary|groundbreaking|game[- ]changing|world[- ]class|industry[- ]leading|best[- ]in[- ]class|unmatched|unparalleled|ultimate|most powerful", "革命性|颠覆性|全球领先|行业领先|遥遥领先|最强|震撼|重磅|划时代"),
}
#: For Arrow's matcher. What a Latin alternative begins and ends with counts as a word's part, or has an end of a word within.
TOLD = {name: rf"\b(?:{texts.caseless(latin)})\b|{texts.caseless(others)}" for name, (latin, others) in WORDS.items()}
#: Tiers that are trusted and that are not, categories of sources that are, and what each kind of claim takes from four dimensions.
TRUSTED, DOUBTED = r"(?i)authoritative|official|primary|validation|top|high|tier[\s_-]?[01]", r"(?i)unverified|unknown|low|tier[\s_-]?[34]"
CATEGORIES = ["research_papers", "official_release", "evaluation_data", "policy_safety_governance"]
TAKEN = {"negation": {"novelty": 3, "impact": 5, "verifiability": 2}, "rumour": {"novelty": 4, "credibility": 7, "impact": 4, "verifiability": 7}, "future": {"novelty": 4, "impact": 5, "verifiability": 3}, "marketing": {"novelty": 2, "credibility": 3, "impact": 3, "verifiability": 3}}
PARTS = {"relevance": ["topic"], "novelty": ["novelty"], "credibility": ["detail", "novelty"], "impact": ["impact", "detail"], "verifiability": ["detail", "impact"]}
NAMES_OF = {"negation": "negated_claim", "rumour": "rumor_or_hearsay", "future": "future_or_planned", "marketing": "marketing_language"}


def excerpts(text: Column) -> Column:
    """Sentences that end in a mark or with the text, trimmed, 320 characters at most; a line that ends otherwise is none."""
    runs = F.regexp_extract_all(text, F.lit(r"((?<![^。！？!?\n])[^。！？!?\n]++(?:[。！？!?]++|\z))"), F.lit(1))
    return F.filter(F.transform(runs, lambda r: F.substring(texts.trimmed(r), 1, 320)), lambda r: r != "")


def evaluated(articles: DataFrame) -> DataFrame:
    """(article_id, relevance, novelty, credibility, impact, verifiability, overall, decision, publish_eligible, reasons, quotes).

    articles: article_id, title, content, url, source_name, source_tier, source_category, published_at; and of the content filter decision
    (null: none), reason_code, n_signals and filter_matches (whether it saw this text and URL). Each dimension has 0 to 20; what denies, reports
    hearsay, looks ahead or praises takes from four of them and blocks; without a detail that can be checked in 80 characters or
    more verifiability is 8 at most. decision: pass, reject (the filter's) or review; quotes: the excerpt that speaks for each dimension.
    """
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    a = articles.select("*", F.explode(F.array(text)).alias("~text"))
    bodies, heads = excerpts(F.coalesce("content", F.lit(""))), excerpts(F.coalesce("title", F.lit("")))
    a = a.select("*", F.explode(F.array(F.struct(heads.alias("heads"), bodies.alias("bodies")))).alias("~excerpts"))
    every = F.concat("~excerpts.heads", "~excerpts.bodies")
    quoted = dict.fromkeys(n for of in PARTS.values() for n in of)
    a = a.select("*", texts.holding(F.col("~text"), TOLD).alias("~has"), texts.first_holding(every, {n: TOLD[n] for n in quoted}).alias("~first"))
    a = a.select(*(c for c in a.columns if c != "~text"))
    yes = lambda test, n, other=0: F.when(test, n).otherwise(other)
    has = {n: F.col("~has")[n] for n in TOLD}
    decision, code = F.col("decision"), F.coalesce("reason_code", F.lit(""))
    matches = F.coalesce(decision.isNotNull() & F.col("filter_matches"), F.lit(False))
    candidate = F.coalesce(decision == "candidate", F.lit(False))
    tier, secure = F.coalesce("source_tier", F.lit("")), F.coalesce(F.col("url").rlike("(?i)^https://"), F.lit(False))
    named, dated = F.coalesce(F.col("source_name") != "", F.lit(False)), F.col("published_at").isNotNull()
    signals = F.greatest(F.coalesce("n_signals", F.lit(0)), F.lit(0))
    signals = F.when(signals > 0, signals).otherwise(yes(has["topic"], 1))
    raw = {
        "relevance": yes(code != "non_ai", yes(candidate & matches, 14, yes(decision == "review", 9, 2)) + F.least(F.lit(6), signals * 2)),
        "novelty": F.least(yes(has["novelty"], 17, yes(candidate, 9, 4)), yes(code == "stale_content", 5, 99)),
        "credibility": yes(tier.rlike(TRUSTED), 17, yes(tier.rlike(DOUBTED), 6, 10)) + yes(F.col("source_category").isin(CATEGORIES), 1) + yes(named, 1) + yes(secure, 1) + yes(dated, 1),
        "impact": yes(has["impact"], 13, 6) + yes(has["detail"], 3),
        "verifiability": 4 + yes(named, 2) + yes(secure, 2) + yes(dated, 2) + yes(has["detail"], 4) + yes(has["novelty"] | has["impact"], 3) + yes(F.size("~excerpts.bodies") >= 2, 2) + yes(tier.rlike(TRUSTED), 2),
    }
    raw["credibility"] = F.least(raw["credibility"], F.lit(20))
    for claim, parts in TAKEN.items():
        for part, n in parts.items():
            raw[part] = raw[part] - yes(has[claim], n)
    thin = (F.length(F.coalesce("content", F.lit(""))) < 80) | ~has["detail"]
    raw["verifiability"] = F.least(raw["verifiability"], yes(thin, 8, 99))
    a = a.select("*", *(F.greatest(F.lit(0), F.least(F.lit(20), c)).cast("int").alias(n) for n, c in raw.items()), thin.alias("~thin"))
    overall = sum((F.col(n) for n in PARTS), F.lit(0))
    fine = {"low_relevance": F.col("relevance") >= 12, "low_credibility": F.col("credibility") >= 10, "low_verifiability": F.col("verifiability") >= 12, "low_overall": overall >= 70}
    blocked = has["negation"] | has["rumour"] | has["future"] | has["marketing"]
    eligible = matches & candidate & ~F.col("~thin") & ~blocked & fine["low_relevance"] & fine["low_credibility"] & fine["low_verifiability"] & fine["low_overall"]
    reasons = [
        F.when(decision.isNull(), "missing_filter_result").when(~matches, "filter_snapshot_mismatch"), F.when(decision == "reject", "filter_rejected"), F.when(decision == "review", "filter_requires_review"), F.when(code == "stale_content", "stale_content"),
        *(F.when(has[c], n) for c, n in NAMES_OF.items()), F.when(F.col("~thin"), "insufficient_evidence"), *(F.when(~test, n) for n, test in fine.items()),
    ]
    at = lambda n: F.coalesce(F.get("~excerpts.heads", n), F.get("~excerpts.bodies", n - F.size("~excerpts.heads")))
    picked = lambda of: F.coalesce(*(at(F.col("~first")[n]) for n in of), F.get("~excerpts.bodies", 0), F.get("~excerpts.heads", 0))
    return a.select(
        "article_id", *PARTS, overall.cast("int").alias("overall"), F.when(eligible, "pass").when(decision == "reject", "reject").otherwise("review").alias("decision"), eligible.alias("publish_eligible"),
        F.array_compact(F.array(*reasons)).alias("reasons"), F.create_map(*(x for n, of in PARTS.items() for x in (F.lit(n), picked(of)))).alias("quotes"),
    )


def reviewed(articles: DataFrame, actions: DataFrame) -> DataFrame:
    """articles (article_id, status, override) after review actions (article_id, action): approve to draft, reject to blocked."""
    last = actions.groupBy("article_id").agg(F.max_by("action", "at").alias("action"))
    done = articles.join(last, "article_id", "left")
    open_ = F.col("status") == "pending_review"
    status = F.when(open_ & (F.col("action") == "approve"), "draft").when(open_ & (F.col("action") == "reject"), "blocked").otherwise(F.col("status"))
    return done.select("article_id", status.alias("status"), (F.col("override") | F.coalesce(open_ & (F.col("action") == "approve"), F.lit(False))).alias("override"))
