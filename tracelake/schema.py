"""Fixed schemas of the telemetry tables."""

SPAN_SCHEMA = """
trace_id string, span_id string, parent_span_id string, name string, kind int,
start_time timestamp_ntz, end_time timestamp_ntz, duration_nano bigint,
status struct<code:int,message:string>, attributes map<string,string>,
resource struct<attributes:map<string,string>>,
events array<struct<name:string,time:timestamp_ntz,attributes:map<string,string>>>,
links array<struct<trace_id:string,span_id:string,attributes:map<string,string>>>,
instrumentation_scope struct<name:string,version:string,schema_url:string>
"""
LOG_SCHEMA = """
timestamp timestamp_ntz, time_unix_nano bigint, severity_text string, body struct<string_value:string>,
resource struct<type:string,attributes:map<string,string>>, trace_id string, span_id string, insert_id string
"""
METRIC_SCHEMA = """
metric_type string, metric_labels map<string,string>, resource_type string,
resource_labels map<string,string>, ts timestamp_ntz, value double
"""
TRACE_DOCUMENT_SCHEMA = """
trace_id string, project_id string,
spans array<struct<span_id:string,name:string,start_time:string,end_time:string,parent_span_id:string,labels:map<string,string>>>
"""
LOG_ENTRY_SCHEMA = """
logName string, timestamp string, severity string, textPayload string, jsonPayload string, protoPayload string,
resource struct<type:string,labels:map<string,string>>, trace string, insertId string
"""
SERIES_SCHEMA = """
metric struct<type:string,labels:map<string,string>>, resource struct<type:string,labels:map<string,string>>,
points array<struct<timestamp:string,value:double>>
"""
