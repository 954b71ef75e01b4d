"""Fixed vocabularies and table schemas of the document store."""

from __future__ import annotations

from pyspark.sql import types as T

# Requirement keywords, longest first where one begins another.
KEYWORDS = ("MUST NOT", "MUST", "REQUIRED", "SHALL NOT", "SHALL", "SHOULD NOT", "SHOULD", "NOT RECOMMENDED", "RECOMMENDED", "MAY", "OPTIONAL")
# Grammar styles, in the order that breaks ties.
GRAMMAR_STYLES = ("abnf", "tls-presentation-lang", "cddl", "asn.1", "none")
# Statuses of an erratum.
ERRATA_STATUSES = ("verified", "reported", "held_for_document_update")
# Documents suggested by a protocol's name in a question.
PROTOCOL_SEEDS = {
    "dns": (1034, 1035, 6891, 8499),
    "http": (9110, 9111, 9112, 9113, 9114),
    "jwt": (7519, 8725),
    "oauth": (6749, 6750, 8414, 8628, 8693, 8705, 9068),
    "quic": (9000, 9001, 9002),
    "smtp": (5321, 5322, 6531),
    "tcp": (9293,),
    "tls": (8446,),
    "uri": (3986, 3987),
}
# The public list of English stop words of text search.
STOP_WORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
    itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
    has had having do does did doing a an the and but if or because as until while of at by for with about against between
    into through during before after above below to from up down in out on off over under again further then once here there
    when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
    just don should now""".split()
)

KEYWORD_PATTERN = r"\b(" + "|".join(KEYWORDS) + r")\b"

SECTIONS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("rfc_number", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("section", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("heading", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("source_sha256", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
DOCUMENTS = T.StructType(
    [
        T.StructField("rfc_number", T.IntegerType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("source_sha256", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("section_count", T.IntegerType()),
        T.StructField("indexed_at_utc", T.TimestampType()),
        T.StructField("updates", T.ArrayType(T.IntegerType())),
        T.StructField("obsoletes", T.ArrayType(T.IntegerType())),
        T.StructField("rfc_date", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("authors", T.ArrayType(T.StringType())),
        T.StructField("issn", T.StringType()),
        T.StructField("grammar_style", T.StringType()),
    ]
)
KEYWORD_HITS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("section_id", T.StringType()),
        T.StructField("rfc_number", T.IntegerType()),
        T.StructField("keyword", T.StringType()),
        T.StructField("line_offset", T.IntegerType()),
    ]
)
GRAMMAR_BLOCKS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("section_id", T.StringType()),
        T.StructField("rfc_number", T.IntegerType()),
        T.StructField("section", T.StringType()),
        T.StructField("abnf_text", T.StringType()),
        T.StructField("rule_names", T.ArrayType(T.StringType())),
    ]
)
ERRATA = T.StructType(
    [
        T.StructField("errata_id", T.IntegerType()),
        T.StructField("rfc_number", T.IntegerType()),
        T.StructField("section", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("original_text", T.StringType()),
        T.StructField("corrected_text", T.StringType()),
        T.StructField("reported_date", T.DateType()),
    ]
)
POSTINGS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("rfc_number", T.IntegerType()),
        T.StructField("section", T.StringType()),
        T.StructField("lexeme", T.StringType()),
        T.StructField("tf", T.LongType()),
    ]
)
MANIFEST = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("mirror_path", T.StringType()),
        T.StructField("parser_type", T.StringType()),
        T.StructField("parser_version", T.StringType()),
        T.StructField("embedding_provider", T.StringType()),
        T.StructField("embedding_model", T.StringType()),
        T.StructField("embedding_dimensions", T.IntegerType()),
        T.StructField("embedding_batch_size", T.IntegerType()),
        T.StructField("rfc_count", T.IntegerType()),
        T.StructField("section_count", T.IntegerType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
