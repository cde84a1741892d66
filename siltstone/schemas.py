"""Schemas of the persisted tables."""

STAT_FACT = "geo string, year long, feature string, value double, unit string, source_system string, source_dataset string, source_column string"
ARTICLE = "article_id string, source string, title string, url string, published_date string, body string"
GKG = "gkg_id string, gkg_date string, document_identifier string, source_common_name string, gkg_themes string, gkg_tone double, gkg_persons string, gkg_organizations string, gkg_locations string, gkg_emotions string"
CROSSWALK = "source_column string, feature string"
FAILURE = "article_id string, source string, url string, title string, published_date string, reason string, timestamp_utc string, model_digest string, raw string"
UIC_STAGING = "table_name string, dataset_id string, table_id string, table_idx long, row_type string, row_idx long, parse_status string, geo string, year long, source_dataset string, source_system string, raw_geo_cell string, raw_year_cell string, raw_value_cells array<string>, text_chunk string, created_at string"
NEWS_FEATURE = (
    "article_id string, source string, url string, published_date string, language string, is_rail_related boolean, country string, event_type string, operators array<string>, rail_lines array<string>, "
    "monetary_amount_eur double, monetary_raw string, summary_en string, sentiment string, confidence double, language_detected_code string, language_confidence double, sentiment_label string, sentiment_score double, "
    "sentiment_confidence double, is_rail_related_confidence double, event_type_confidence double, summary_en_source string, operators_ner_model string, operators_confidence double, rail_lines_ner_model string, "
    "rail_lines_confidence double, monetary_raw_parsed_eur double, monetary_confidence double, gkg_themes string, gkg_persons string, gkg_organizations string, gkg_locations string, gkg_tone double, gkg_emotions string, "
    "gkg_tone_source string, text_embedding_model string, text_embedding array<float>, cluster_id string, cross_lingual_dedup_id string, extraction_timestamp_utc string, extraction_model_digest string, "
    "confidence_schema_version string, is_duplicate boolean"
)
