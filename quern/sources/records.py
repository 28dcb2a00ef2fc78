"""Single-record metadata payloads, read by declarative specs.

A spec names, for each output field, a JSON path and whether the field is required. All specs give
the same row shape, so payloads of any mix of sources are read in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("record_id", "title", "published", "license", "canonical_url", "description")


@dataclass(frozen=True)
class Spec:
    """How one source's payload maps to a row; ``url`` is a prefix for ids where no URL is given."""

    paths: dict[str, str]
    required: tuple[str, ...] = ("record_id", "title")
    authors: str | None = None
    author_name: str | None = None
    url: str | None = None
    extra: dict[str, str] = field(default_factory=dict)


#: Paths into the public JSON formats of each source (fixed values of those formats).
SPECS: dict[str, Spec] = {
    "crossref": Spec({"record_id": "$.message.DOI", "title": "$.message.title[0]", "published": "$.message.issued.date-parts[0][0]", "license": "$.message.license[0].URL", "canonical_url": "$.message.URL", "description": "$.message.abstract"}, authors="$.message.author", author_name="given family"),
    "datacite": Spec({"record_id": "$.data.attributes.doi", "title": "$.data.attributes.titles[0].title", "published": "$.data.attributes.publicationYear", "license": "$.data.attributes.rightsList[0].rights", "canonical_url": "$.data.attributes.url"}, authors="$.data.attributes.creators", author_name="name"),
    "dblp": Spec({"record_id": "$.info.key", "title": "$.info.title", "published": "$.info.year", "canonical_url": "$.info.url"}, authors="$.info.authors.author", author_name="text"),
    "doaj": Spec({"record_id": "$.id", "title": "$.bibjson.title", "published": "$.bibjson.year", "license": "$.bibjson.license[0].type", "canonical_url": "$.bibjson.link[0].url", "description": "$.bibjson.abstract"}, authors="$.bibjson.author", author_name="name"),
    "europepmc": Spec({"record_id": "$.id", "title": "$.title", "published": "$.firstPublicationDate", "license": "$.license", "description": "$.abstractText"}, authors="$.authorList.author", author_name="fullName", url="https://europepmc.org/article/MED/"),
    "figshare": Spec({"record_id": "$.id", "title": "$.title", "published": "$.published_date", "license": "$.license.name", "canonical_url": "$.url_public_html", "description": "$.description"}, authors="$.authors", author_name="full_name"),
    "hal": Spec({"record_id": "$.halId_s", "title": "$.title_s[0]", "published": "$.producedDate_s", "license": "$.licence_s", "canonical_url": "$.uri_s"}, authors="$.authFullName_s"),
    "huggingface": Spec({"record_id": "$.id", "title": "$.id", "published": "$.lastModified", "license": "$.cardData.license"}, url="https://huggingface.co/"),
    "internet_archive": Spec({"record_id": "$.metadata.identifier", "title": "$.metadata.title", "published": "$.metadata.date", "license": "$.metadata.licenseurl", "description": "$.metadata.description"}, url="https://archive.org/details/"),
    "loc": Spec({"record_id": "$.item.id", "title": "$.item.title", "published": "$.item.date", "license": "$.item.rights", "canonical_url": "$.item.id", "description": "$.item.description[0]"}, authors="$.item.contributors"),
    "mastodon": Spec({"record_id": "$.id", "title": "$.account.display_name", "published": "$.created_at", "canonical_url": "$.url", "description": "$.content"}),
    "medrxiv": Spec({"record_id": "$.collection[0].doi", "title": "$.collection[0].title", "published": "$.collection[0].date", "license": "$.collection[0].license", "description": "$.collection[0].abstract"}, url="https://doi.org/"),
    "biorxiv": Spec({"record_id": "$.collection[0].doi", "title": "$.collection[0].title", "published": "$.collection[0].date", "license": "$.collection[0].license", "description": "$.collection[0].abstract"}, url="https://doi.org/"),
    "nsf_awards": Spec({"record_id": "$.response.award[0].id", "title": "$.response.award[0].title", "published": "$.response.award[0].startDate", "description": "$.response.award[0].abstractText"}, url="https://www.nsf.gov/awardsearch/showAward?AWD_ID="),
    "openaire": Spec({"record_id": "$.id", "title": "$.mainTitle", "published": "$.publicationDate", "license": "$.bestAccessRight.label", "description": "$.descriptions[0]"}, authors="$.authors", author_name="fullName"),
    "openalex_authors": Spec({"record_id": "$.id", "title": "$.display_name", "canonical_url": "$.id", "description": "$.last_known_institutions[0].display_name"}, extra={"orcid": "$.orcid"}),
    "openalex_works": Spec({"record_id": "$.id", "title": "$.title", "published": "$.publication_date", "license": "$.primary_location.license", "canonical_url": "$.id"}, extra={"inverted_index": "$.abstract_inverted_index"}),
    "openreview": Spec({"record_id": "$.id", "title": "$.content.title.value", "published": "$.pdate", "description": "$.content.abstract.value"}, authors="$.content.authors.value", url="https://openreview.net/forum?id="),
    "orcid_public": Spec({"record_id": "$.orcid-identifier.path", "title": "$.person.name.credit-name.value", "canonical_url": "$.orcid-identifier.uri"}, required=("record_id",)),
    "osf": Spec({"record_id": "$.data.id", "title": "$.data.attributes.title", "published": "$.data.attributes.date_published", "canonical_url": "$.data.links.html", "description": "$.data.attributes.description"}),
    "paperswithcode": Spec({"record_id": "$.id", "title": "$.title", "published": "$.published", "canonical_url": "$.url_abs", "description": "$.abstract"}, authors="$.authors"),
    "pubmed": Spec({"record_id": "$.uid", "title": "$.title", "published": "$.pubdate"}, authors="$.authors", author_name="name", url="https://pubmed.ncbi.nlm.nih.gov/"),
    "semantic_scholar": Spec({"record_id": "$.paperId", "title": "$.title", "published": "$.year", "license": "$.openAccessPdf.license", "canonical_url": "$.url"}, authors="$.authors", author_name="name"),
    "unpaywall": Spec({"record_id": "$.doi", "title": "$.title", "published": "$.year", "license": "$.best_oa_location.license", "canonical_url": "$.doi_url"}, extra={"oa_status": "$.oa_status"}),
    "wikidata": Spec({"record_id": "$.id", "title": "$.labels.en.value", "description": "$.descriptions.en.value"}, url="https://www.wikidata.org/wiki/"),
    "worldbank": Spec({"record_id": "$.id", "title": "$.display_title", "published": "$.docdt", "license": "$.majdocty", "canonical_url": "$.url"}),
    "youtube_metadata": Spec({"record_id": "$.items[0].id", "title": "$.items[0].snippet.title", "published": "$.items[0].snippet.publishedAt", "description": "$.items[0].snippet.description"}, url="https://www.youtube.com/watch?v="),
    "zenodo": Spec({"record_id": "$.id", "title": "$.metadata.title", "published": "$.metadata.publication_date", "license": "$.metadata.license.id", "canonical_url": "$.links.self_html", "description": "$.metadata.description"}, authors="$.metadata.creators", author_name="name"),
    "github": Spec({"record_id": "$.id", "title": "$.full_name", "published": "$.created_at", "license": "$.license.spdx_id", "canonical_url": "$.html_url", "description": "$.description"}),
    "bluesky": Spec({"record_id": "$.post.uri", "title": "$.post.author.handle", "published": "$.post.record.createdAt", "description": "$.post.record.text"}),
    "forum_magnum": Spec({"record_id": "$._id", "title": "$.title", "published": "$.postedAt", "canonical_url": "$.pageUrl", "description": "$.contents.html"}),
    "aiid": Spec({"record_id": "$.incident_id", "title": "$.title", "published": "$.date", "description": "$.description"}, url="https://incidentdatabase.ai/cite/"),
    "oecd_ai": Spec({"record_id": "$.id", "title": "$.englishName", "published": "$.startYear", "canonical_url": "$.publicAccessUrl", "description": "$.description"}),
    "cordis": Spec({"record_id": "$.project.id", "title": "$.project.title", "published": "$.project.startDate", "description": "$.project.objective"}, url="https://cordis.europa.eu/project/id/"),
    "acl_anthology": Spec({"record_id": "$.id", "title": "$.title", "published": "$.year", "description": "$.abstract"}, authors="$.authors", url="https://aclanthology.org/"),
}


def _authors(payload: Column, spec: Spec) -> Column:
    if spec.authors is None:
        return F.array().cast("array<string>")
    raw = F.get_json_object(payload, spec.authors)
    if spec.author_name is None:
        return F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))
    parts = spec.author_name.split()
    items = F.coalesce(F.from_json(raw, "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))
    return F.filter(F.transform(items, lambda a: F.trim(F.concat_ws(" ", *[F.try_element_at(a, F.lit(p)) for p in parts]))), lambda n: n != "")


def read_records(payloads: DataFrame, source: str = "source", payload: str = "payload", specs: dict[str, Spec] = SPECS) -> DataFrame:
    """Add the common fields, ``authors``, ``extra`` (a map) and ``failure`` to rows of (source, payload).

    ``failure`` is unknown_source, unreadable, or the first required field that is missing.
    """
    p, s = F.col(payload), F.col(source)

    def pick(name: str) -> Column:
        out = F.lit(None).cast("string")
        for key, spec in specs.items():
            value = F.get_json_object(p, spec.paths[name]) if name in spec.paths else F.concat(F.lit(spec.url), F.get_json_object(p, spec.paths["record_id"])) if name == "canonical_url" and spec.url else None
            if value is not None:
                out = F.when(s == key, value).otherwise(out)
        return F.nullif(F.trim(out), F.lit(""))

    rows = payloads.select("*", *[pick(f).alias(f) for f in FIELDS])
    authors, extra, failure = F.array().cast("array<string>"), F.create_map().cast("map<string,string>"), F.lit("unknown_source")
    for key, spec in specs.items():
        authors = F.when(s == key, _authors(p, spec)).otherwise(authors)
        if spec.extra:
            extra = F.when(s == key, F.create_map(*[x for k, path in spec.extra.items() for x in (F.lit(k), F.get_json_object(p, path))])).otherwise(extra)
        missing = F.coalesce(*[F.when(F.col(f).isNull(), F.lit(f"missing_{f}")) for f in spec.required])
        failure = F.when(s == key, F.when(F.try_parse_json(p).isNull(), "unreadable").otherwise(missing)).otherwise(failure)
    return rows.select("*", authors.alias("authors"), extra.alias("extra"), failure.alias("failure"))
