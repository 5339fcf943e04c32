"""Hosts, domains and run identifiers. Every function maps columns to a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of public and academic bodies.
AUTHORITY_SUFFIXES = ("edu", "gov", "gov.uk", "ac.uk", "mil")
#: Domains that count as authorities.
AUTHORITY_DOMAINS = (
    "wikipedia.org", "scholar.google.com", "ncbi.nlm.nih.gov", "arxiv.org", "nature.com", "sciencedirect.com", "ieee.org",
    "acm.org", "researchgate.net", "pubmed.ncbi.nlm.nih.gov", "springer.com", "wiley.com", "jstor.org", "ssrn.com",
    "nber.org", "who.int", "un.org", "worldbank.org", "statista.com", "pewresearch.org", "gallup.com",
)
#: Hosts whose links are no citations.
LINK_FILTER = (
    "facebook.com", "twitter.com", "x.com", "linkedin.com", "instagram.com", "pinterest.com", "tiktok.com", "youtube.com",
    "apple.com", "play.google.com", "apps.apple.com", "cdn.jsdelivr.net", "cdnjs.cloudflare.com", "fonts.googleapis.com",
    "ajax.googleapis.com", "maxcdn.bootstrapcdn.com",
)
#: Domains of vendors.
BRANDS = (
    "salesforce.com", "hubspot.com", "microsoft.com", "oracle.com", "sap.com", "adobe.com", "google.com", "ibm.com",
    "cisco.com", "servicenow.com", "workday.com", "zendesk.com", "atlassian.com", "slack.com", "zoom.us", "dropbox.com",
    "shopify.com", "twilio.com", "datadog.com", "snowflake.com", "cloudflare.com", "okta.com", "pagerduty.com",
    "elastic.co", "mongodb.com", "confluent.io", "hashicorp.com", "databricks.com", "stripe.com", "brevo.com",
    "mailchimp.com", "intercom.com", "freshworks.com", "zoho.com", "monday.com", "asana.com", "notion.so", "airtable.com",
    "clickup.com", "smartsheet.com", "wix.com", "squarespace.com", "bigcommerce.com", "klaviyo.com", "semrush.com",
    "ahrefs.com", "moz.com", "hootsuite.com", "buffer.com", "sproutsocial.com", "canva.com", "figma.com", "webflow.com",
    "unbounce.com", "activecampaign.com", "drift.com", "gong.io", "outreach.io", "salesloft.com", "docusign.com",
    "pandadoc.com", "calendly.com", "loom.com", "vidyard.com", "wistia.com", "typeform.com", "surveymonkey.com",
    "qualtrics.com", "amplitude.com", "mixpanel.com", "segment.com", "braze.com", "iterable.com", "appcues.com",
    "pendo.io", "gainsight.com", "totango.com", "churnzero.com", "chargebee.com", "recurly.com", "zuora.com", "bill.com",
    "xero.com", "quickbooks.intuit.com", "netsuite.com", "sage.com", "gusto.com", "rippling.com", "bamboohr.com",
    "paylocity.com", "paycom.com", "deel.com", "remote.com", "oysterhr.com", "lever.co", "greenhouse.io", "ashbyhq.com",
    "gem.com", "procore.com", "autodesk.com", "plangrid.com", "buildertrend.com", "toast.com", "lightspeed.com",
    "mindbodyonline.com", "zenoti.com", "veeva.com", "clio.com", "appfolio.com",
)


def source_type(domain: Column, earned: Column) -> Column:
    """brand, earned or other. ``earned`` says whether the domain is in the list of media and review sites, which is a
    table given by the user; the vendors' list comes first."""
    return F.when(F.lower(F.trim(domain)).isin(*BRANDS), "brand").when(F.coalesce(earned, F.lit(False)), "earned").otherwise("other")


def domain_of(url: Column) -> Column:
    """The host with port and case as they are, without a leading "www."; other text stays as it is."""
    host = F.regexp_extract(url, r"^https?://([^/]+)", 1)
    return F.when(host != "", F.regexp_replace(host, r"^www\.", "")).otherwise(url)


def registrable(host: Column) -> Column:
    """The last two labels."""
    return F.substring_index(host, ".", -2)


def link_host(href: Column) -> Column:
    """Lower-case host of an http(s) link without "www.", else null."""
    host = F.lower(F.regexp_extract(href, r"(?i)^https?://([^/?#:]+)", 1))
    return F.when(host != "", F.regexp_replace(host, r"^www\.", ""))


def link_suffix(host: Column) -> Column:
    """The two-label authority suffix where there is one, else the last label."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*AUTHORITY_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def stripped_host(text: Column) -> Column:
    """Host without any leading "w" and "." characters (a known defect that archived tables carry)."""
    host = F.regexp_extract(text, r"^(?:[a-z]+://)?([^/]+)", 1)
    return F.regexp_replace(host, r"^[w.]+", "")


def page_key(url: Column) -> Column:
    """Name of a page in the page store: 16 hex digits of its address's digest."""
    return F.concat(F.substring(F.sha2(url, 256), 1, 16), F.lit(".html"))


def run_parts(run_id: Column) -> dict[str, Column]:
    """Engine, model, pool, top_n and variant of engine_model_poolN_topN[_variant]; null parts where it doesn't parse."""
    pattern = r"^([a-z0-9]+)_(.+)_pool(\d+)_top(\d+)(?:_(.+))?$"
    part = lambda i: F.nullif(F.regexp_extract(run_id, pattern, i), F.lit(""))
    return {"engine": part(1), "model": part(2), "pool": part(3).cast("int"), "top_n": part(4).cast("int"), "variant": part(5)}


def engine_alias(engine: Column) -> Column:
    return F.when(engine == "duckduckgo", "ddg").otherwise(engine)


def short_model(model: Column) -> Column:
    return F.substring_index(model, "/", -1)
