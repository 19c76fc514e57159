"""Queries of the source readers: dumps are written from the tables' rows and read back, so they grow with them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import identifiers as ids
from lodestrata.operators import bibliography as bb
from lodestrata.plans.registry import query
from lodestrata.sources import papers as src
from lodestrata.tables import new_path

c = F.col
FILE_KEYS = 20_000  #: keys of a file of XML


def _written(df, column, spark, name: str) -> str:
    path = new_path(spark, name)
    df.select(column.alias("value")).write.text(path)
    return path


def _xml(df, column, key: str, spark, name: str) -> str:
    """Files of one root element each, a line for each row of a range of FILE_KEYS keys, however the input is split."""
    path = new_path(spark, name)
    w = Window.partitionBy("p").orderBy(key)
    rows = df.select(F.floor(c(key) / FILE_KEYS).alias("p"), key, column.alias("x"))
    rows = rows.withColumns({"k": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("p"))})
    line = F.concat(F.when(c("k") == 1, "<set>\n").otherwise(""), "x", F.when(c("k") == c("n"), "\n</set>").otherwise(""))
    rows.select("p", line.alias("value")).write.partitionBy("p").text(path)
    return path


def _openalex(t):
    k = c("p_partkey")
    own = lambda x: F.concat(F.lit("https://openalex.org/W"), x.cast("string"))
    index = F.map_from_arrays(F.transform(F.array_distinct(F.split("p_name", " ")), lambda w: w), F.transform(F.array_distinct(F.split("p_name", " ")), lambda w: F.filter(F.transform(F.split("p_name", " "), lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())))
    author = F.array(F.struct(F.struct(c("p_brand").alias("display_name")).alias("author")))
    row = F.to_json(F.struct(F.when(k % 50 != 0, own(k)).alias("id"), F.when(k % 2 == 0, F.concat(F.lit("https://doi.org/10.1/"), k.cast("string"))).alias("doi"), c("p_name").alias("title"), (1950 + c("p_size")).alias("publication_year"), F.when(k % 3 == 0, c("p_size")).alias("cited_by_count"), F.when(k % 4 != 0, index).alias("abstract_inverted_index"), author.alias("authorships"), F.array(own(k + 1), F.concat(F.lit("http://elsewhere/"), k.cast("string"))).alias("referenced_works")))
    return src.read_openalex(t.spark, _written(t.part, row, t.spark, "openalex"))


@query("src_openalex", "SELECT 'openalex:W' || p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '10.1/' || p_partkey END AS doi, p_name AS title, 1950 + p_size AS year, p_brand AS authors, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 0 END AS citation_count, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS abstract FROM {part} WHERE p_partkey % 50 <> 0")
def src_openalex(t):
    return _openalex(t)[0].select("id", "doi", "title", "year", F.array_join("authors", ";").alias("authors"), "citation_count", "abstract")


@query("src_openalex_edges", "SELECT 'openalex:W' || p_partkey AS src, 'openalex:W' || (p_partkey + 1) AS dst FROM {part} WHERE p_partkey % 50 <> 0")
def src_openalex_edges(t):
    return _openalex(t)[1].where("src is not null")


def _s2(t):
    k = c("p_partkey")
    paper = lambda x, title: F.struct(x.cast("string").alias("paperId"), title.alias("title"))
    row = F.to_json(F.struct(F.when(k % 50 != 0, k.cast("string")).alias("paperId"), c("p_name").alias("title"), c("p_size").alias("year"), F.create_map(F.lit("DOI"), F.concat(F.lit("10.2/"), k.cast("string"))).alias("externalIds"), F.array(F.struct(c("p_brand").alias("name"))).alias("authors"), F.array(paper(k + 1, c("p_name")), paper(F.lit(None), c("p_name"))).alias("references"), F.array(paper(k - 1, c("p_name"))).alias("citations")))
    return src.read_s2(t.spark, _written(t.part, row, t.spark, "s2"))


@query("src_s2", "SELECT 's2:' || p_partkey AS id, '10.2/' || p_partkey AS doi, NULL::VARCHAR AS arxiv_id, p_name AS title, p_size AS year, p_brand AS authors, 0 AS citation_count FROM {part} WHERE p_partkey % 50 <> 0")
def src_s2(t):
    return _s2(t)[0].select("id", "doi", "arxiv_id", "title", "year", F.array_join("authors", ";").alias("authors"), "citation_count")


@query("src_s2_edges", "SELECT DISTINCT 's2:' || a AS src, 's2:' || (a + 1) AS dst FROM (SELECT p_partkey AS a FROM {part} WHERE p_partkey % 50 <> 0 UNION ALL SELECT p_partkey - 1 FROM {part} WHERE p_partkey % 50 <> 0) x")
def src_s2_edges(t):
    return _s2(t)[1]


@query("src_pubmed", "SELECT 'pmid:' || p_partkey AS id, p_partkey::VARCHAR AS pmid, CASE WHEN p_partkey % 2 = 0 THEN '10.3/' || p_partkey END AS doi, p_name AS title, 1950 + p_size AS year, 'Ann ' || p_brand AS authors, CASE WHEN p_partkey % 3 <> 0 THEN p_type || ' ' || p_brand END AS abstract FROM {part}")
def src_pubmed(t):
    k = c("p_partkey").cast("string")
    say = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    doi = F.when(c("p_partkey") % 2 == 0, say('<ArticleId IdType="doi">10.3/', k, "</ArticleId>")).otherwise("")
    abstract = F.when(c("p_partkey") % 3 != 0, say("<Abstract><AbstractText>", c("p_type"), "</AbstractText><AbstractText>", c("p_brand"), "</AbstractText></Abstract>")).otherwise("")
    row = say("<PubmedArticle><MedlineCitation><PMID>", k, "</PMID><Article><ArticleTitle>", c("p_name"), "</ArticleTitle>", abstract, "<AuthorList><Author><LastName>", c("p_brand"), '</LastName><ForeName>Ann</ForeName></Author></AuthorList></Article></MedlineCitation><PubmedData><History><PubMedPubDate PubStatus="pubmed"><Year>', (1950 + c("p_size")).cast("string"), '</Year></PubMedPubDate></History><ArticleIdList><ArticleId IdType="pubmed">', k, "</ArticleId>", doi, "</ArticleIdList></PubmedData></PubmedArticle>")
    rows = src.read_pubmed_xml(t.spark, _xml(t.part, row, "p_partkey", t.spark, "pubmed"))
    return rows.select("id", "pmid", "doi", "title", "year", F.array_join("authors", ";").alias("authors"), "abstract")


@query("src_pubmed_summaries", "SELECT 'pmid:' || p_partkey AS id, p_partkey::VARCHAR AS pmid, CASE WHEN p_partkey % 2 = 0 THEN '10.3/' || p_partkey END AS doi, p_name AS title, 1950 + p_size AS year, p_brand || ' A' AS authors FROM {part} WHERE p_partkey % 6 <> 0")
def src_pubmed_summaries(t):
    """A summary holds its papers under their ids; those with an error are left out."""
    k = c("p_partkey").cast("string")
    doi = F.when(c("p_partkey") % 2 == 0, F.array(F.struct(F.lit("doi").alias("idtype"), F.concat(F.lit("10.3/"), k).alias("value"))))
    one = F.struct(k.alias("uid"), F.when(c("p_partkey") % 6 == 0, "gone").alias("error"), c("p_name").alias("title"), F.concat((1950 + c("p_size")).cast("string"), F.lit(" Jan")).alias("pubdate"), F.array(F.struct(F.concat("p_brand", F.lit(" A")).alias("name"))).alias("authors"), doi.alias("articleids"))
    text = F.concat(F.lit('{"result": {"uids": ["'), k, F.lit('"], "'), k, F.lit('": '), F.to_json(one), F.lit("}}"))
    rows = src.read_pubmed_summaries(t.spark, _written(t.part, text, t.spark, "esummary"))
    return rows.select("id", "pmid", "doi", "title", "year", F.array_join("authors", ";").alias("authors"))


@query("src_arxiv", "SELECT 'arxiv:2101.' || (10000 + p_partkey % 90000) AS id, p_name AS title, 1950 + p_size AS year, p_brand AS authors, p_type AS abstract, 'cs.LG;' || p_brand AS fields FROM {part}")
def src_arxiv(t):
    say = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    row = say("<entry><id>http://arxiv.org/abs/2101.", (10000 + c("p_partkey") % 90000).cast("string"), "v2</id><title> ", F.replace("p_name", F.lit(" "), F.lit("  ")), "</title><summary>", c("p_type"), "</summary><published>", (1950 + c("p_size")).cast("string"), "-02-03T00:00:00Z</published><author><name>", c("p_brand"), '</name></author><category term="', c("p_brand"), '"/><category term="cs.LG"/><primary_category term="cs.LG"/></entry>')
    rows = src.read_arxiv_atom(t.spark, _xml(t.part, row, "p_partkey", t.spark, "arxiv"))
    return rows.select("id", "title", "year", F.array_join("authors", ";").alias("authors"), "abstract", F.array_join("fields_of_study", ";").alias("fields"))


@query("src_html_bibliography", "SELECT p_partkey AS page_id, unnest([0, 1]) AS ordinal, unnest([p_name || ' (' || p_size || ')', p_brand]) AS raw FROM {part} WHERE p_partkey % 3 <> 0")
def src_html_bibliography(t):
    say = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    html = F.when(c("p_partkey") % 3 != 0, say('<p>x</p><section id="bib" class="a ltx_bibliography"><ul><li class="ltx_bibitem"><b>', c("p_name"), "</b>\n <i>(", c("p_size").cast("string"), ')</i></li><li class="ltx_bibitem"> </li><li class="ltx_bibitem">', c("p_brand"), "</li></ul></section>")).otherwise("<section><li>no</li></section>")
    return src.html_bib_entries(t.part.select(c("p_partkey").alias("page_id"), html.alias("html")), 10)


@query("src_bank", "SELECT 'q' || item_id AS question_id, category, difficulty, question, correct_option_id AS keys FROM {exam_items}")
def src_bank(t):
    none = F.array().cast("array<struct<option_id:string,text:string>>")
    rows = t.exam_items.select(F.concat(F.lit("q"), c("item_id").cast("string")).alias("question_id"), F.lit("p").alias("paper_id"), "category", "difficulty", "question", none.alias("options"), F.array("correct_option_id").alias("correct_option_ids"))
    path = new_path(t.spark, "bank")
    src.write_bank(rows, path)
    return src.read_bank(t.spark, path).select("question_id", "category", "difficulty", "question", F.array_join("correct_option_ids", "").alias("keys"))


def _bibliographies(t):
    """Papers of parts whose bibliographies name other parts, the fields a model read from them, and the catalogue."""
    k = c("p_partkey")
    papers = t.bib_texts.select(c("doc_id").alias("paper_id"), "text")
    said = t.part.select(k.alias("k"), "p_name", "p_type", "p_brand")
    entry = lambda n: F.concat(c("k").cast("string"), F.lit(f":{n}"))
    null = F.lit(None).cast("string")
    row = lambda n, title, author, doi, arxiv, pmid, sure: said.select(entry(n).alias("entry_id"), title.alias("title"), F.array(F.lit(author)).alias("authors"), F.lit(None).cast("int").alias("year"), doi.alias("doi"), arxiv.alias("arxiv_id"), pmid.alias("pmid"), F.lit(sure).alias("confidence"))
    mapped = row(1, c("p_name"), "Smith, A.", F.concat(F.lit("10.1000/"), c("k").cast("string")), null, null, 0.9)
    mapped = mapped.unionByName(row(2, c("p_type"), "Jones, B.", null, F.concat(F.lit("2101."), (10000 + c("k") % 10000).cast("string")), null, 0.9))
    mapped = mapped.unionByName(row(3, c("p_brand"), "Brown, C.", F.lit("10.9/invented"), null, (c("k") + 1).cast("string"), 0.4))
    rows = t.papers.select("id", "title", "doi", c("arxiv_id").alias("arxiv"), null.alias("pmid"), F.array().cast("array<string>").alias("authors"), F.lit(None).cast("int").alias("year"), "provider", k.cast("string").alias("native"))
    rows = rows.withColumns({"provider_rank": F.lit(1), "completeness": F.lit(1), "key": c("id")})
    aliases = t.papers.where(k % 10 == 0).select(F.concat(F.lit("pmid:"), (k + 1).cast("string")).alias("alias"), "id")
    return papers, mapped, rows, aliases


def _graph(t):
    return bb.build_reference_graph(*_bibliographies(t))


@query("job_reference_accounts", "SELECT p_partkey AS paper_id, 3 AS entries, 3 AS mapped, FALSE AS lacking FROM {part}")
def job_reference_accounts(t):
    return _graph(t)["accounts"].select("paper_id", "entries", "mapped", "lacking")


@query("job_reference_graph")
def job_reference_graph(t):
    return _graph(t)["edges"]


@query("str_dedup_reference", "SELECT p_partkey, 'doi:10.1000/' || p_partkey AS key FROM {papers} WHERE p_partkey % 3 = 0")
def str_dedup_reference(t):
    """The DOI that an entry's text shows is the key of the paper it names."""
    raw = bb.raw_entries(t.bib_texts.select(c("doc_id").alias("paper_id"), "text")).where("ordinal = 1")
    doi = F.get(ids.extract_doi(c("raw")), F.lit(0))
    return raw.where("paper_id % 3 = 0").select(c("paper_id").alias("p_partkey"), ids.alias_key("doi", doi).alias("key"))
