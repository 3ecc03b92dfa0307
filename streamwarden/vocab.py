"""IRIs. All entries are fixed values of public vocabularies, unless marked as ours."""

# Public vocabulary terms.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD_FLOAT = "http://www.w3.org/2001/XMLSchema#float"
XSD_DATETIME = "http://www.w3.org/2001/XMLSchema#dateTime"
XSD_INTEGER = "http://www.w3.org/2001/XMLSchema#integer"
XSD_STRING = "http://www.w3.org/2001/XMLSchema#string"
SAREF = "https://saref.etsi.org/core/"
HAS_VALUE = SAREF + "hasValue"
HAS_TIMESTAMP = SAREF + "hasTimestamp"
RELATES_TO = SAREF + "relatesToProperty"
MADE_BY = SAREF + "measurementMadeBy"
MEASUREMENT = SAREF + "Measurement"
IN_DATASET = "http://rdfs.org/ns/void#inDataset"
VERSION_OF = "http://purl.org/dc/terms/isVersionOf"
DCT_SOURCE = "http://purl.org/dc/terms/source"
DCT_DESCRIPTION = "http://purl.org/dc/terms/description"
TREE = "https://w3id.org/tree#"
TREE_MEMBER = TREE + "member"
TREE_VIEW = TREE + "view"
TREE_RELATION = TREE + "relation"
TREE_NODE_CLASS = TREE + "Node"
TREE_NODE = TREE + "node"
TREE_PATH = TREE + "path"
TREE_VALUE = TREE + "value"
TREE_GREATER_EQ = TREE + "GreaterThanOrEqualToRelation"
LDES_STREAM = "https://w3id.org/ldes#EventStream"
LDES_TIMESTAMP_PATH = "https://w3id.org/ldes#timestampPath"
LDES_VERSION_OF_PATH = "https://w3id.org/ldes#versionOfPath"
LDP_CONTAINS = "http://www.w3.org/ns/ldp#contains"
LDP_INBOX = "http://www.w3.org/ns/ldp#inbox"
PROV_DERIVED = "http://www.w3.org/ns/prov#wasDerivedFrom"
PROV_GENERATED_BY = "http://www.w3.org/ns/prov#generatedBy"
RSP_STARTED = "http://w3id.org/rsp/vocals-sd#startedAt"
RSP_ENDED = "http://w3id.org/rsp/vocals-sd#endedAt"
RSP_STREAMS = "http://w3id.org/rsp/vocals-sd#registeredStreams"
PREFIX_TERM = "http://purl.org/vocab/vann/preferredNamespacePrefix"
RULE_LOCATION = "http://example.org/hasRuleLocation"
FOCUS_PREDICATES = (
    "https://saref.etsi.org/core/relatesToProperty",
    "https://www.w3.org/2000/01/rdf-schema#range",
)
FNO = "https://w3id.org/function/ontology#"
FNO_HTTP = "http://w3id.org/function/ontology#"
SAO_STREAM_DATA = "http://purl.oclc.org/NET/UNIS/sao/sao#StreamData"
ODRL_PURPOSE = "http://www.w3.org/ns/odrl/2/purpose"
LEGAL_BASIS = "https://w3id.org/oac#LegalBasis"

# Ours: neutral defaults, each can be replaced by a parameter.
EVENT_BASE = "http://example.org/aggregation_event/"
AGGREGATOR_AGENT = "http://example.org/monitor/AggregatorService"
PARAMETER_BASE = "http://example.org/monitor/parameters/"
STREAM_BASE = "http://example.org/streams/"
EX = "http://example.org/#"
