"""Readers and writers: message files, the event log, and a mailbox source."""
