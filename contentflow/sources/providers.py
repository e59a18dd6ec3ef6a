"""Provider API dumps (JSON documents) to raw entries, followees and author candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow import schemas
from contentflow.functions import text
from contentflow.functions.binding import staged
from contentflow.operators.merge import last_known
from contentflow.sources.feeds import ITEMS_PER_DOCUMENT

POSTS = """username string, data array<struct<id:string, text:string, created_at:string, in_reply_to_user_id:string,
 referenced_tweets:array<struct<type:string,id:string>>,
 entities:struct<urls:array<struct<expanded_url:string,unwound_url:string,url:string>>>>>"""
QA_ITEMS = "Items array<struct<Url:string, Title:string, CreatedAt:bigint, Summary:string, Author:struct<Name:string>>>"
QA_FOLLOWEES = "Items array<struct<UrlToken:string, Fullname:string, Url:string, AvatarUrl:string, Headline:string, FollowerCount:bigint>>"
OPENALEX = """results array<struct<id:string, doi:string, title:string, publication_date:string,
 primary_location:struct<landing_page_url:string>>>"""
SEMANTIC = """data array<struct<paperId:string, title:string, abstract:string, publicationDate:string,
 externalIds:struct<DOI:string,ArXiv:string>, openAccessPdf:struct<url:string>, url:string>>"""
ORCID = """`group` array<struct<`work-summary`:array<struct<title:struct<title:struct<value:string>>,
 `external-ids`:struct<`external-id`:array<struct<`external-id-type`:string,`external-id-value`:string>>>,
 `publication-date`:struct<year:struct<value:string>,month:struct<value:string>,day:struct<value:string>>,
 url:struct<value:string>, `put-code`:string>>>>"""
OPENALEX_AUTHORS = "results array<struct<id:string, display_name:string, orcid:string>>"
SEMANTIC_AUTHORS = "data array<struct<authorId:string, name:string, externalIds:struct<ORCID:string>>>"

_filled = text.blank_to_null


def _items(raw: DataFrame, schema: str, field: str) -> DataFrame:
    """One row per array element of every document, in document order."""
    parsed = staged(raw, doc=F.from_json("text", schema))
    return parsed.select(*raw.columns, "doc", F.posexplode(f"doc.{field}").alias("pos", "item")).withColumn(
        "seq", F.col("seq") * ITEMS_PER_DOCUMENT + F.col("pos")
    )


def raw_entry_rows(rows: DataFrame, **fields: Column) -> DataFrame:
    kinds = {part.split()[0]: part.split()[1] for part in schemas.RAW_ENTRY.replace("\n", " ").split(",")}
    given = {"source_id": F.col("source_id"), "seq": F.col("seq"), **fields}
    return rows.select(*[given.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in schemas.columns(schemas.RAW_ENTRY)])


def is_original_post(replied_to: Column, references: Column) -> Column:
    """Neither a reply nor a repost; quotes stay."""
    reposted = F.exists(references, lambda r: r["type"].isin("retweeted", "reposted"))
    return _filled(replied_to).isNull() & ~F.coalesce(reposted, F.lit(False))


def post_rows(raw: DataFrame) -> DataFrame:
    """Every post of the dump with its author and id, before any filter (the cursor needs them all)."""
    return _items(raw, POSTS, "data").select(
        "source_id", "seq", F.col("doc.username").alias("username"), F.col("item.id").alias("post_id"), "item"
    )


def post_entries(posts: DataFrame) -> DataFrame:
    """Original posts as raw entries; a post without id or text is left out."""
    item = F.col("item")
    body = staged(
        posts.where(is_original_post(item["in_reply_to_user_id"], item["referenced_tweets"])),
        body=text.compact(item["text"]),
    )
    kept = body.where(_filled(F.col("post_id")).isNotNull() & F.col("body").isNotNull())
    handle = F.replace(F.url_encode("username"), F.lit("+"), F.lit("%20"))
    number = F.replace(F.url_encode("post_id"), F.lit("+"), F.lit("%20"))
    return raw_entry_rows(
        kept,
        url=F.concat(F.lit("https://x.com/"), handle, F.lit("/status/"), number),
        title=text.compact(F.col("body")),
        summary=F.col("body"),
        author=F.concat(F.lit("@"), F.col("username")),
        published_at=text.instant_ms(item["created_at"]),
        external_id=F.col("post_id"),
        canonical_identity=F.concat(F.lit("x:"), F.col("post_id")),
        provider_id=F.lit("x"),
        provider_label=F.lit("X"),
    )


def post_links(posts: DataFrame) -> DataFrame:
    """First expanded link of every post."""
    found = F.transform(
        F.col("item.entities.urls"), lambda u: F.coalesce(_filled(u["unwound_url"]), _filled(u["expanded_url"]), _filled(u["url"]))
    )
    return posts.select("post_id", F.get(F.filter(found, lambda u: u.isNotNull()), F.lit(0)).alias("external_url"))


def parse_posts(raw: DataFrame) -> DataFrame:
    return post_entries(post_rows(raw))


def parse_qa_items(raw: DataFrame) -> DataFrame:
    """Contents or collections of a Q&A account; seconds become milliseconds."""
    rows = _items(raw, QA_ITEMS, "Items").where(_filled(F.col("item.Url")).isNotNull())
    return raw_entry_rows(
        rows,
        url=F.col("item.Url"),
        title=F.coalesce(text.compact(F.col("item.Title")), F.lit("知乎内容")),
        published_at=F.try_multiply("item.CreatedAt", F.lit(1000)),
        summary=text.compact(F.col("item.Summary")),
        author=text.compact(F.col("item.Author.Name")),
    )


def parse_followees(raw: DataFrame, as_of: int) -> DataFrame:
    """Followees of each account over its pages; ``seq`` is their order."""
    return _items(raw, QA_FOLLOWEES, "Items").select(
        "source_id",
        "seq",
        F.col("item.UrlToken").alias("url_token"),
        F.coalesce(text.compact(F.col("item.Fullname")), F.lit("知乎用户")).alias("fullname"),
        F.col("item.Url").alias("url"),
        F.col("item.AvatarUrl").alias("avatar_url"),
        text.compact(F.col("item.Headline")).alias("headline"),
        F.col("item.FollowerCount").alias("follower_count"),
        F.lit(as_of).cast("bigint").alias("updated_at"),
    )


def _doi_url(doi: Column) -> Column:
    return F.concat(F.lit("https://doi.org/"), doi)


def _scholarly(rows: DataFrame, label: str) -> DataFrame:
    """Shared end of the three dumps: needs doi, landing, work_title, day, abstract, work_id, identity."""
    kept = rows.where(F.col("landing").isNotNull() & F.col("work_title").isNotNull())
    return raw_entry_rows(
        kept,
        url=F.coalesce(_doi_url(F.col("doi")), F.col("landing")),
        title=F.col("work_title"),
        author=F.col("author_name"),
        published_at=F.col("day"),
        summary=F.coalesce("abstract", F.lit(f"{label} · 公开 works 记录" if label == "ORCID" else f"{label} · 学术论文")),
        external_id=F.coalesce("work_id", "doi", "landing"),
        canonical_identity=F.coalesce(F.concat(F.lit("doi:"), F.col("doi")), "identity"),
        provider_id=F.lit("academic"),
        provider_label=F.lit(label),
    )


def parse_scholarly(raw: DataFrame, authors: DataFrame) -> DataFrame:
    """Works from the three provider dumps in one shape.

    ``raw`` carries ``provider`` (openalex, semantic, orcid); ``authors`` names
    the author and ORCID per source. A work is identified by DOI, then arXiv
    id, then the provider's own id.
    """
    named = raw.join(authors.select("source_id", "author_name", "orcid"), "source_id")
    none = F.lit(None).cast("string")

    openalex = _items(named.where(F.col("provider") == "openalex"), OPENALEX, "results")
    landing = F.coalesce(_filled(F.col("item.primary_location.landing_page_url")), _filled(F.col("item.id")))
    first = openalex.withColumns(
        {
            "doi": text.normal_doi(F.col("item.doi")),
            "landing": landing,
            "work_title": text.compact(F.col("item.title")),
            "day": text.instant_ms(F.col("item.publication_date")),
            "abstract": none,
            "work_id": _filled(F.col("item.id")),
            "identity": F.concat(F.lit("openalex:"), F.coalesce(_filled(F.col("item.id")), landing)),
        }
    )

    semantic = staged(
        _items(named.where(F.col("provider") == "semantic"), SEMANTIC, "data"), doi=text.normal_doi(F.col("item.externalIds.DOI"))
    )
    paper = F.coalesce(_filled(F.col("item.url")), _filled(F.col("item.openAccessPdf.url")), _doi_url(F.col("doi")))
    arxiv = F.lower(_filled(F.trim("item.externalIds.ArXiv")))
    second = semantic.withColumns(
        {
            "landing": paper,
            "work_title": text.compact(F.col("item.title")),
            "day": text.instant_ms(F.col("item.publicationDate")),
            "abstract": text.compact(F.col("item.abstract")),
            "work_id": _filled(F.col("item.paperId")),
            "identity": F.coalesce(
                F.concat(F.lit("arxiv:"), arxiv), F.concat(F.lit("semantic:"), F.coalesce(_filled(F.col("item.paperId")), paper))
            ),
        }
    )

    summary = F.get(F.col("item.`work-summary`"), F.lit(0))
    orcid = _items(named.where(F.col("provider") == "orcid"), ORCID, "`group`").withColumn("work", summary)
    external = F.col("work.`external-ids`.`external-id`")
    doi = F.get(F.filter(external, lambda e: F.lower(e["external-id-type"]) == "doi"), F.lit(0))["external-id-value"]
    date = F.col("work.`publication-date`")
    code = _filled(F.col("work.`put-code`"))
    third = staged(orcid, doi=text.normal_doi(doi)).withColumns(
        {
            "landing": F.coalesce(_doi_url(F.col("doi")), _filled(F.col("work.url.value"))),
            "work_title": text.compact(F.col("work.title.title.value")),
            "day": text.partial_date_ms(date["year"]["value"], date["month"]["value"], date["day"]["value"]),
            "abstract": none,
            "work_id": code,
            "identity": F.concat(F.lit("orcid:"), F.col("orcid"), F.lit(":"), F.coalesce(code, F.col("work.url.value"))),
        }
    )
    parts = [_scholarly(first, "OpenAlex"), _scholarly(second, "Semantic Scholar"), _scholarly(third, "ORCID")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def author_candidates(raw: DataFrame) -> DataFrame:
    """Author search answers of two providers: ``(search, seq, title, target_id, author_name, openalex_id, semantic_id, orcid)``."""
    none = F.lit(None).cast("string")
    openalex = _items(raw.where(F.col("provider") == "openalex"), OPENALEX_AUTHORS, "results").select(
        F.col("source_id").alias("search"), "seq", text.compact(F.col("item.display_name")).alias("author_name"),
        text.normal_openalex(F.col("item.id")).alias("openalex_id"), none.alias("semantic_id"), text.normal_orcid(F.col("item.orcid")).alias("orcid"),
        F.lit("OpenAlex").alias("label"), F.lit(0).alias("rank"),
    )
    semantic = _items(raw.where(F.col("provider") == "semantic"), SEMANTIC_AUTHORS, "data").select(
        F.col("source_id").alias("search"), "seq", text.compact(F.col("item.name")).alias("author_name"),
        none.alias("openalex_id"), _filled(F.col("item.authorId")).alias("semantic_id"), text.normal_orcid(F.col("item.externalIds.ORCID")).alias("orcid"),
        F.lit("Semantic Scholar").alias("label"), F.lit(1).alias("rank"),
    )
    both = openalex.unionByName(semantic).where(F.col("author_name").isNotNull() & F.coalesce("openalex_id", "semantic_id").isNotNull())
    target = F.coalesce(F.concat(F.lit("openalex:"), F.col("openalex_id")), F.concat(F.lit("semantic:"), F.col("semantic_id")))
    return both.withColumns({"title": F.concat("author_name", F.lit(" · "), "label"), "target_id": target}).drop("label")


def merge_authors(candidates: DataFrame) -> DataFrame:
    """Candidates of one search that mean the same author, folded in provider order.

    The key is the ORCID, else the folded name. Later providers fill or
    replace fields; the first one gives the target, a merged one is titled by name.
    """
    order = F.struct("rank", "seq")
    key = F.coalesce("orcid", F.lower(F.trim("author_name"))).alias("author_key")
    folded = candidates.groupBy("search", key).agg(
        F.count("*").alias("n"),
        F.min_by(F.struct("title", "target_id"), order).alias("first"),
        F.max_by("author_name", order).alias("author_name"),
        last_known("openalex_id", order).alias("openalex_id"),
        last_known("semantic_id", order).alias("semantic_id"),
        last_known("orcid", order).alias("orcid"),
    )
    title = F.when(F.col("n") > 1, F.col("author_name")).otherwise(F.col("first.title"))
    return folded.select(
        "search", "author_key", title.alias("title"), F.col("first.target_id").alias("target_id"), "author_name", "openalex_id", "semantic_id", "orcid"
    )


def provider_union(parts: list[DataFrame], statuses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of every provider that answered, and the searches that failed everywhere and found nothing.

    ``statuses`` holds ``(source_id, provider, ok)``.
    """
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    dead = statuses.groupBy("source_id").agg(F.bool_or("ok").alias("any_ok")).where(~F.col("any_ok")).select("source_id")
    return rows, dead.join(rows.select("source_id"), "source_id", "left_anti")
