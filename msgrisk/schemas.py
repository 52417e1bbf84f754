"""Declared schemas of every record the library reads or writes."""

from __future__ import annotations

ELEMENT = "struct<MsgType:string,MsgContent:struct<Text:string,Desc:string,Data:string>>"

# Body of a chat callback.
CALLBACK_BODY = (
    "CallbackCommand string, From_Account string, To_Account string, "
    "MsgSeq bigint, MsgRandom bigint, MsgTime bigint, MsgKey string, MsgId string, "
    f"OnlineOnlyFlag int, MsgBody array<{ELEMENT}>, CloudCustomData string, EventTime bigint"
)

# Request parameters beside the body, as a scan delivers them.
ENVELOPE = "SdkAppid string, CallbackCommand string, OptPlatform string, body string"

# Structured verdict of a scorer.
VERDICT = (
    "rating double, fraud_type string, reasoning string, advice string, "
    "url_analysis string, risk_keywords array<string>"
)

PAGE_RECORD = "url string, title string, content string, status string, method string, error string"

STEP = "struct<step:int,name:string,result:string,status:string>"

WORKFLOW_RESULT = (
    f"input_text string, workflow_steps array<{STEP}>, final_analysis string, "
    "timestamp timestamp, status string, error string, failed_step int, stopped_at string"
)

TOOL_CALL = "struct<id:string,name:string,args:map<string,string>>"

# Dataset columns that are always present; others are carried along.
DATASET = "content string, rating double"
