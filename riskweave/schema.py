"""Schemas of what comes in and goes out."""

MESSAGE = "message_id string, conversation_id string, sender_id string, ts timestamp, text string, trust string, stage string, prior_violations int, advisory boolean"
REQUEST = "id string, op string, text string, conversationID string, senderID string, trust string, stage string, priorViolations int, advisory boolean, ts timestamp"
SIGNAL = "signal_id string, op string, sender_id string, conversation_id string, ts timestamp"
CONTEXT = "conversation_id string, ts timestamp, stage string, trust string, prior_violations int"
DECISION = "message_id string, conversation_id string, sender_id string, ts timestamp, action string, score double, threshold double, reasons array<string>, masked_text string, policy_version string"
