"""Schemas of the rows that gates read and write."""

from __future__ import annotations

FINDINGS = "gate string, code string, severity string, message string, path string, line int, context string"
VALUES = (
    "ref string, ns string, key string, origin string, value_text string, value_double double, value_type string, display string, "
    "digits int, unit string, quoted boolean, label boolean, same_as string, bounds string, bound string, level string, source string"
)
FRAGMENT = (
    "provenance struct<generated_by:string,generated_by_sha256:string,generated_at:string,inputs:array<struct<path:string,sha256:string,bytes:bigint>>>, "
    "values map<string,struct<value:variant,display:string,digits:int,unit:string,quoted:boolean,label:boolean,same_as:string,bounds:string,bound:string,level:string>>, "
    "tables map<string,struct<caption:string,columns:array<string>,rows:array<array<string>>,quoted:boolean,"
    "composed:array<struct<row:int,column:int,template:string,parts:array<string>,codes:boolean>>>>, "
    "code_lists map<string,array<struct<concept:string,system:string,codes:array<string>>>>"
)
