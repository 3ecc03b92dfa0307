"""Schemas of the tables the engine passes around."""

TRIPLES = (
    "resource_id string, stream string, s string, s_kind string, p string, o string, "
    "o_kind string, o_datatype string, o_lang string, event_time timestamp"
)
OBSERVATIONS = "resource_id string, stream string, property string, value double, event_time timestamp"
BUCKETS = "stream string, bucket string, lower_ts timestamp"
RULES = (
    "rule_set string, rule_id string, premise_p string, lower double, lower_incl boolean, "
    "upper double, upper_incl boolean, derived_p string, derived_o string"
)
AGGREGATION_EVENTS = (
    "event_id string, query_hash string, value double, window_start timestamp, "
    "window_end timestamp, generated_at timestamp, streams array<string>"
)
SUBSCRIPTIONS = "query_hash string, subscriber string"
QUERY_AUDIT = (
    "query_id string, query string, registered_by string, registered_at timestamp, "
    "similar_queries_id array<string>"
)
QUERY_ACCESS = "query_id string, user string, accessed_at timestamp, data_accessed string"
GRANTS = "resource string, agent string"
NOTIFICATIONS = "type string, target string, published timestamp, body string"
POLICIES = (
    "target string, assigner string, assignee string, action string, "
    "constraints array<struct<left:string,op:string,right:string>>"
)
