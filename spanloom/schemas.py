"""Schemas, in one place: nothing is inferred."""

from __future__ import annotations

SPAN = (
    "seq long, arrival_seq long, batch_id long, trace_id string, span_id string, parent_id string, name string, kind string, service_name string, "
    "scope struct<name:string,version:string>, started_at timestamp, ended_at timestamp, error boolean, status_message string, observed_at timestamp, attributes string, "
    "events array<struct<name:string,time_unix_nano:long,attributes:string>>, links array<struct<trace_id:string,span_id:string,attributes:string>>, otlp string, resource_attributes string"
)
_VALUE = "struct<key:string,value:string>"
OTLP_REQUEST = (
    "resourceSpans array<struct<resource:struct<attributes:array<" + _VALUE + ">>,scopeSpans:array<struct<scope:struct<name:string,version:string>,spans:array<struct<"
    "traceId:string,spanId:string,parentSpanId:string,traceState:string,flags:int,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,attributes:array<" + _VALUE + ">,"
    "droppedAttributesCount:int,droppedEventsCount:int,droppedLinksCount:int,"
    "events:array<struct<name:string,timeUnixNano:string,attributes:array<" + _VALUE + ">>>,links:array<struct<traceId:string,spanId:string,attributes:array<" + _VALUE + ">>>,"
    "status:struct<code:int,message:string>>>>>>>"
)
TAXONOMY = "TAG string, Domain string, Category string, `Data Type` string, regulatory_tags string, `Is Personalized` string"
TEXT_LINES = "index long, text string"
EVAL_ITEM = "item_id long, suite string, text string"
