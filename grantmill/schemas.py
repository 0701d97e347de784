"""Explicit schemas of every table; readers never infer."""

EXTRA = (
    "STRUCT<matched_phrases: ARRAY<STRING>, funder_type: STRING,"
    " coordinating_organisation: STRING, programme: STRING, acronym: STRING,"
    " status: STRING, total_cost: DOUBLE, organization: STRING,"
    " activity_code: STRING, subproject_id: STRING, broad_only: BOOLEAN>"
)
CENSUS = (
    "record_id STRING, source STRING, source_id STRING, title STRING,"
    " abstract STRING, funder STRING, country STRING, year INT, amount DOUBLE,"
    " currency STRING, amount_eur DOUBLE, fx_date STRING, url STRING,"
    f" extra {EXTRA}, retrieved_at STRING"
)
SWECRIS_RAW = (
    "ProjectId STRING, FundingOrganisationId STRING, FundingStartDate STRING,"
    " ProjectTitleEn STRING, ProjectTitleSv STRING, ProjectAbstractEn STRING,"
    " ProjectAbstractSv STRING, FundingsSek STRING,"
    " FundingOrganisationNameEn STRING, FundingOrganisationNameSv STRING,"
    " FundingOrganisationTypeOfOrganisationEn STRING,"
    " CoordinatingOrganisationNameEn STRING"
)
CORDIS_PROJECT_RAW = (
    "id STRING, title STRING, objective STRING, startDate STRING,"
    " ecMaxContribution STRING, totalCost STRING, acronym STRING, status STRING"
)
CORDIS_ORG_RAW = "projectID STRING, role STRING, country STRING"
REPORTER_RAW = (
    "project_num STRING, subproject_id STRING, project_title STRING,"
    " abstract_text STRING, fiscal_year INT, award_amount DOUBLE,"
    " organization STRUCT<org_name: STRING>, agency_ic_admin STRUCT<name: STRING>,"
    " activity_code STRING"
)
LABELS = (
    "record_id STRING, source STRING, region STRING, year INT, funder STRING,"
    " amount_eur DOUBLE, title STRING, url STRING, label STRING,"
    " matched_keywords MAP<STRING, ARRAY<STRING>>, anchor_terms ARRAY<STRING>,"
    " reason STRING, confidence DOUBLE, llm_category STRING"
)
ADJUDICATION = (
    "record_id STRING, label STRING, quote STRING, confidence STRING,"
    " reason STRING, raw_model STRING, retrieved_at STRING, quote_valid BOOLEAN,"
    " error STRING, adjudicated_by STRING, seq BIGINT"
)
EXPERT = (
    "record_id STRING, source STRING, expert_label STRING, confidence STRING,"
    " reason STRING, rule_path STRING, judged_at STRING"
)
JUDGMENT = (
    "record_id STRING, labeller_id STRING, geroscience STRING, cancer BOOLEAN,"
    " cant_tell BOOLEAN, reason STRING, labelled_at TIMESTAMP,"
    " record_fingerprint STRING"
)
VERDICT = (
    "STRUCT<verdict: STRING, label: STRING, record_fingerprint: STRING,"
    " note: STRING, reviewed_at: STRING>"
)
JUDGE_MARK = (
    "STRUCT<record_fingerprint: STRING, judged_at: STRING, judges: MAP<STRING,"
    " STRUCT<verdict: STRING, reason: STRING, proposed_label: STRING>>>"
)
FINDING = (
    "id STRING, type STRING, country STRING, region STRING,"
    " classification STRING, claim STRING, source_url STRING,"
    " source_date STRING, confidence STRING, source_note STRING,"
    " search_note STRING, retrieved_at STRING"
)
FINDING_VERDICT = (
    "STRUCT<finding_id: STRING, finding_fingerprint: STRING, checks: MAP<STRING,"
    " BOOLEAN>, reviewed: BOOLEAN, correct: BOOLEAN, reviewer: STRING,"
    " note: STRING, reviewed_at: STRING>"
)
AWARD_WIDE = (
    "HRCS2022_ID STRING, FundingOrganisation STRING, AwardTitle STRING,"
    " AwardAbstract STRING, `2022AnnualisedValue` STRING, HC_1 STRING,"
    " HC_2 STRING, HC_3 STRING, HC_4 STRING, HC_5 STRING, RA_1 STRING,"
    " RA_2 STRING, RA_3 STRING, RA_4 STRING, CodingType STRING"
)
LEXICON_ENTRY = (
    "STRUCT<term: STRING, precision: DOUBLE, weight: DOUBLE, requires: STRING,"
    " requires_ageing_anchor: BOOLEAN, variant_of: STRING, low_evidence: BOOLEAN,"
    " hits: BIGINT>"
)
LEXICON_BLOCK = (
    f"STRUCT<requires_ageing_anchor: BOOLEAN, en: ARRAY<{LEXICON_ENTRY}>,"
    f" sv: ARRAY<{LEXICON_ENTRY}>, trap_terms: ARRAY<{LEXICON_ENTRY}>,"
    f" conditional_voters: ARRAY<{LEXICON_ENTRY}>>"
)
LEXICON_DOCUMENT = (
    f"categories MAP<STRING, {LEXICON_BLOCK}>,"
    f" meta STRUCT<broad_net: STRUCT<en: ARRAY<{LEXICON_ENTRY}>,"
    f" sv: ARRAY<{LEXICON_ENTRY}>>, exclusion_markers: ARRAY<{LEXICON_ENTRY}>,"
    " thresholds: MAP<STRING, STRUCT<min_hits: BIGINT, min_precision: DOUBLE>>>"
)
