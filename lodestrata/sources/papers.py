"""Dumps of paper catalogues as tables of papers and citation edges; schemas are explicit, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPENALEX = "id string, doi string, title string, publication_year int, cited_by_count int, abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<display_name:string>>>, referenced_works array<string>, topics array<struct<display_name:string>>"
S2_PAPER = "paperId:string,title:string,year:int,citationCount:int,abstract:string,externalIds:map<string,string>,authors:array<struct<name:string>>"
S2 = "paperId string, title string, year int, citationCount int, abstract string, externalIds map<string,string>, authors array<struct<name:string>>, " + f"references array<struct<{S2_PAPER}>>, citations array<struct<{S2_PAPER}>>"
OPENALEX_URL = "https://openalex.org/"  #: fixed value
PUBMED = "MedlineCitation struct<PMID:struct<_VALUE:string>,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<string>>,AuthorList:struct<Author:array<struct<ForeName:string,LastName:string>>>>>, PubmedData struct<History:struct<PubMedPubDate:array<struct<_PubStatus:string,Year:int>>>,ArticleIdList:struct<ArticleId:array<struct<_IdType:string,_VALUE:string>>>>"
ARXIV = "id string, title string, summary string, published string, author array<struct<name:string>>, category array<struct<_term:string>>, primary_category struct<_term:string>"


def abstract_from_inverted(index: Column) -> Column:
    """Words by ascending position; of two words at one position the later in the index stays. Null and empty give null."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w")))))
    order = F.array_sort(placed)
    kept = F.filter(order, lambda x, k: F.coalesce(F.get(order, k + 1)["p"] != x["p"], F.lit(True)))
    return F.nullif(F.array_join(F.transform(kept, lambda x: x["w"]), " "), F.lit(""))


def read_openalex(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(papers, edges) of a works dump, one JSON object a line."""
    rows = spark.read.schema(OPENALEX).json(path)
    own = lambda c: F.concat(F.lit("openalex:"), F.substring_index(c, "/", -1))
    papers = rows.where("id is not null").select(
        own(F.col("id")).alias("id"),
        F.regexp_replace("doi", "^https?://doi.org/", "").alias("doi"),
        "title",
        F.col("publication_year").alias("year"),
        F.transform("authorships", lambda a: a["author"]["display_name"]).alias("authors"),
        F.coalesce("cited_by_count", F.lit(0)).alias("citation_count"),
        abstract_from_inverted(F.col("abstract_inverted_index")).alias("abstract"),
        F.lit("openalex").alias("provider"),
        F.transform("topics", lambda t: t["display_name"]).alias("fields_of_study"),
    )
    edges = rows.select(own(F.col("id")).alias("src"), F.explode("referenced_works").alias("w")).where(F.col("w").startswith(OPENALEX_URL)).select("src", own(F.col("w")).alias("dst")).distinct()
    return papers, edges


def read_s2(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(papers, edges) of a dump with references and citations; list items without paperId are dropped."""
    rows = spark.read.schema(S2).json(path).where("paperId is not null")
    own = lambda c: F.concat(F.lit("s2:"), c)
    papers = rows.select(own(F.col("paperId")).alias("id"), F.col("externalIds")["DOI"].alias("doi"), F.col("externalIds")["ArXiv"].alias("arxiv_id"), "title", "year", F.transform("authors", lambda a: a["name"]).alias("authors"), F.coalesce("citationCount", F.lit(0)).alias("citation_count"), "abstract", F.lit("semantic_scholar").alias("provider"))
    out = rows.select(own(F.col("paperId")).alias("src"), F.explode("references").alias("r")).where("r.paperId is not null").select("src", own(F.col("r.paperId")).alias("dst"))
    into = rows.select(own(F.col("paperId")).alias("dst"), F.explode("citations").alias("r")).where("r.paperId is not null").select(own(F.col("r.paperId")).alias("src"), "dst")
    return papers, out.unionByName(into).distinct()


def read_pubmed_xml(spark: SparkSession, path: str) -> DataFrame:
    """papers of PubmedArticle elements: names as ForeName LastName, abstract parts joined, year of the pubmed date."""
    rows = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(PUBMED).load(path)
    a = "MedlineCitation.Article"
    doi = F.get(F.filter("PubmedData.ArticleIdList.ArticleId", lambda x: x["_IdType"] == "doi"), F.lit(0))["_VALUE"]
    year = F.get(F.filter("PubmedData.History.PubMedPubDate", lambda x: x["_PubStatus"] == "pubmed"), F.lit(0))["Year"]
    return rows.select(F.concat(F.lit("pmid:"), "MedlineCitation.PMID._VALUE").alias("id"), F.col("MedlineCitation.PMID._VALUE").alias("pmid"), doi.alias("doi"), F.col(f"{a}.ArticleTitle").alias("title"), year.alias("year"), F.transform(f"{a}.AuthorList.Author", lambda x: F.trim(F.concat_ws(" ", x["ForeName"], x["LastName"]))).alias("authors"), F.nullif(F.array_join(f"{a}.Abstract.AbstractText", " "), F.lit("")).alias("abstract"), F.lit("pubmed").alias("provider"))


SUMMARY = "map<string,string>"
SUMMARY_ROW = "uid string, error string, title string, pubdate string, authors array<struct<name:string>>, articleids array<struct<idtype:string,value:string>>"


def read_pubmed_summaries(spark: SparkSession, path: str) -> DataFrame:
    """papers of summaries, one JSON object a line: its result holds each paper under its id, beside the list uids; papers with an
    error are left out."""
    rows = spark.read.text(path)
    each = rows.select(F.explode(F.from_json(F.get_json_object("value", "$.result"), SUMMARY)).alias("key", "body")).where("key <> 'uids'")
    x = each.select(F.from_json("body", SUMMARY_ROW).alias("x")).where("x.uid is not null and x.error is null").select("x.*")
    doi = F.get(F.filter("articleids", lambda a: a["idtype"] == "doi"), F.lit(0))["value"]
    return x.select(F.concat(F.lit("pmid:"), "uid").alias("id"), F.col("uid").alias("pmid"), doi.alias("doi"), "title", F.expr("try_cast(left(pubdate, 4) as int)").alias("year"), F.transform("authors", lambda a: a["name"]).alias("authors"), F.lit(None).cast("string").alias("abstract"), F.lit("pubmed").alias("provider"))


def read_arxiv_atom(spark: SparkSession, path: str) -> DataFrame:
    """papers of Atom entries: id after /abs/ without its version, year from the date, the primary category first."""
    rows = spark.read.format("xml").option("rowTag", "entry").schema(ARXIV).load(path)
    native = F.regexp_replace(F.regexp_extract("id", "/abs/(.+)$", 1), r"v\d+$", "")
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    kinds = F.array_distinct(F.array_compact(F.concat(F.array("primary_category._term"), F.coalesce(F.transform("category", lambda x: x["_term"]), F.array().cast("array<string>")))))
    return rows.select(F.concat(F.lit("arxiv:"), native).alias("id"), native.alias("arxiv_id"), clean(F.col("title")).alias("title"), F.expr("try_cast(left(published, 4) as int)").alias("year"), F.transform("author", lambda x: x["name"]).alias("authors"), clean(F.col("summary")).alias("abstract"), kinds.alias("fields_of_study"), F.lit("arxiv").alias("provider"))


def html_bib_entries(pages: DataFrame, most: int) -> DataFrame:
    """page_id, ordinal, raw: the list items of the first section of class ltx_bibliography, tags stripped, empty ones left out."""
    section = F.regexp_extract("html", r'(?s)<section[^>]*class="[^"]*ltx_bibliography[^"]*"[^>]*>(.*?)</section>', 1)
    items = F.regexp_extract_all(section, F.lit(r'(?s)<li[^>]*class="[^"]*ltx_bibitem[^"]*"[^>]*>(.*?)</li>'), F.lit(1))
    texts = F.filter(F.transform(items, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "(?s)<[^>]+>", " "), r"\s+", " "))), lambda x: x != "")
    return pages.select("page_id", F.posexplode(F.slice(texts, F.lit(1), F.lit(most))).alias("ordinal", "raw"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema("papers array<struct<paper_id:string,title:string>>, categories map<string,int>, difficulties map<string,int>, bank_sha256 string").json(path)


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """Questions, one JSON object a line; empty lines are skipped, a malformed one fails the job."""
    schema = "question_id string, paper_id string, category string, difficulty string, question string, options array<struct<option_id:string,text:string>>, correct_option_ids array<string>"
    return spark.read.option("mode", "FAILFAST").schema(schema).json(path)


def write_bank(questions: DataFrame, path: str) -> None:
    questions.orderBy("question_id").write.json(path)
