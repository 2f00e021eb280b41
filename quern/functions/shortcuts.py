"""Site shortcuts: ``!key terms`` goes to a site's search, ``!key`` alone to its home."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import percent_encode

# Fixed values, in display order: keys | name | home | search, {q} stands for the terms | blurb.
SITES = [  # keys, name, home, search form, blurb
    ('yt youtube', 'YouTube', 'https://www.youtube.com', 'https://www.youtube.com/results?search_query={q}', 'video lectures, talks, and tutorials'),
    ('gh github', 'GitHub', 'https://github.com', 'https://github.com/search?q={q}&type=repositories', 'source code, repositories, and projects'),
    ('ol overleaf', 'Overleaf', 'https://www.overleaf.com', 'https://www.overleaf.com/latex/templates?q={q}', 'collaborative LaTeX papers and templates'),
    ('so stackoverflow', 'Stack Overflow', 'https://stackoverflow.com', 'https://stackoverflow.com/search?q={q}', 'programming questions and answers'),
    ('w wiki wikipedia', 'Wikipedia', 'https://en.wikipedia.org', 'https://en.wikipedia.org/w/index.php?search={q}', 'the free encyclopedia'),
    ('ax arxiv', 'arXiv', 'https://arxiv.org', 'https://arxiv.org/search/?query={q}&searchtype=all', 'open-access e-prints in physics, math, and CS'),
    ('sc scholar', 'Google Scholar', 'https://scholar.google.com', 'https://scholar.google.com/scholar?q={q}', 'scholarly papers and citations'),
    ('wa wolfram', 'Wolfram Alpha', 'https://www.wolframalpha.com', 'https://www.wolframalpha.com/input?i={q}', 'computational answers and math'),
    ('mdn', 'MDN Web Docs', 'https://developer.mozilla.org', 'https://developer.mozilla.org/en-US/search?q={q}', 'web platform and JavaScript reference'),
    ('li linkedin', 'LinkedIn', 'https://www.linkedin.com', 'https://www.linkedin.com/search/results/all/?keywords={q}', 'professional network, jobs, and people'),
    ('md medium', 'Medium', 'https://medium.com', 'https://medium.com/search?q={q}', 'articles, essays, and technical blogs'),
    ('kg kaggle', 'Kaggle', 'https://www.kaggle.com', 'https://www.kaggle.com/search?q={q}', 'datasets, notebooks, and ML competitions'),
    ('r reddit', 'Reddit', 'https://www.reddit.com', 'https://www.reddit.com/search/?q={q}', 'communities and discussion threads'),
    ('hn hackernews', 'Hacker News', 'https://news.ycombinator.com', 'https://hn.algolia.com/?q={q}', 'startup and technology news'),
    ('dev devto', 'DEV Community', 'https://dev.to', 'https://dev.to/search?q={q}', 'developer articles and discussion'),
    ('hf huggingface', 'Hugging Face', 'https://huggingface.co', 'https://huggingface.co/search/full-text?q={q}', 'models, datasets, and ML spaces'),
    ('gpt chatgpt', 'ChatGPT', 'https://chatgpt.com', 'https://chatgpt.com/?q={q}', "OpenAI's chat assistant"),
    ('cl claude', 'Claude', 'https://claude.ai', 'https://claude.ai/new?q={q}', "Anthropic's AI assistant"),
    ('npm', 'npm', 'https://www.npmjs.com', 'https://www.npmjs.com/search?q={q}', 'JavaScript package registry'),
    ('cr crates', 'crates.io', 'https://crates.io', 'https://crates.io/search?q={q}', 'the Rust package registry'),
    ('pypi', 'PyPI', 'https://pypi.org', 'https://pypi.org/search/?q={q}', 'the Python package index'),
    ('g google', 'Google', 'https://www.google.com', 'https://www.google.com/search?q={q}', 'the web search engine'),
    ('ddg', 'DuckDuckGo', 'https://duckduckgo.com', 'https://duckduckgo.com/?q={q}', 'privacy-first web search'),
    ('gm gmail', 'Gmail', 'https://mail.google.com', 'https://mail.google.com/mail/u/0/#search/{q}', 'your email'),
    ('maps gmaps', 'Google Maps', 'https://maps.google.com', 'https://www.google.com/maps/search/{q}', 'maps, directions, and places'),
    ('drive gdrive', 'Google Drive', 'https://drive.google.com', 'https://drive.google.com/drive/search?q={q}', 'your files and documents'),
    ('x twitter', 'X (Twitter)', 'https://x.com', 'https://x.com/search?q={q}', 'posts and real-time updates'),
    ('az amazon', 'Amazon', 'https://www.amazon.com', 'https://www.amazon.com/s?k={q}', 'online shopping'),
    ('nf netflix', 'Netflix', 'https://www.netflix.com', 'https://www.netflix.com/search?q={q}', 'films and series'),
    ('sp spotify', 'Spotify', 'https://open.spotify.com', 'https://open.spotify.com/search/{q}', 'music and podcasts'),
    ('imdb', 'IMDb', 'https://www.imdb.com', 'https://www.imdb.com/find/?q={q}', 'films, TV, and cast'),
    ('tw twitch', 'Twitch', 'https://www.twitch.tv', 'https://www.twitch.tv/search?term={q}', 'live streams and gaming'),
    ('nt notion', 'Notion', 'https://www.notion.so', 'https://www.notion.so/search?q={q}', 'notes, docs, and wikis'),
    ('fig figma', 'Figma', 'https://www.figma.com', 'https://www.figma.com/community/search?resource_type=mixed&q={q}', 'collaborative design'),
]


def site_rows() -> list[tuple]:
    return [(i, keys.split(), *rest) for i, (keys, *rest) in enumerate(SITES)]


def sites(spark: SparkSession) -> DataFrame:
    """site_id, keys, name, home, search, blurb; a fixed table of 34 rows."""
    return spark.createDataFrame(site_rows(), "site_id int, keys array<string>, name string, home string, search string, blurb string")


def resolve(queries: DataFrame) -> DataFrame:
    """query_id, url of the queries (query_id, q) whose first known ``!key`` names a site."""
    words = F.filter(F.split(F.trim(F.col("q")), r"(?U)\s+"), lambda w: w != "")
    keyed = sites(queries.sparkSession).select(F.explode("keys").alias("key"), "home", "search")
    placed = queries.select("query_id", words.alias("words")).select("query_id", "words", F.posexplode("words").alias("i", "w")).where("w like '!%'")
    known = placed.select("query_id", "words", "i", F.lower(F.substring("w", 2, 100)).alias("key")).join(F.broadcast(keyed), "key")
    first = known.groupBy("query_id").agg(F.min_by(F.struct("words", "i", "home", "search"), "i").alias("x")).select("query_id", "x.*")
    terms = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("i")), F.slice("words", F.col("i") + 2, F.size("words"))), " ")
    return first.select("query_id", F.when(terms == "", F.col("home")).otherwise(F.replace(F.col("search"), F.lit("{q}"), percent_encode(terms))).alias("url"))


def with_launch_cards(docs: DataFrame, first_id: int) -> DataFrame:
    """``docs`` (doc_id, url, title, text, rank, ...) and the sites' cards under ids from ``first_id``, at the greatest rank."""
    most = docs.agg(F.coalesce(F.max("rank"), F.lit(0.0)).alias("rank"))
    own = launch_cards(docs.sparkSession).withColumn("doc_id", F.monotonically_increasing_id() + F.lit(first_id)).crossJoin(F.broadcast(most))  # most is one row
    return docs.unionByName(own, allowMissingColumns=True)


def launch_cards(spark: SparkSession) -> DataFrame:
    """url, title, text: the pages by which the sites themselves are found."""
    text = F.format_string("%s — %s. Quick-launch shortcut: !%s (%s).", "name", "blurb", F.get("keys", F.lit(0)), F.array_join("keys", " "))
    return sites(spark).select(F.col("home").alias("url"), F.col("name").alias("title"), text.alias("text"))
