"""Structured Streaming forms of batch operators (see ``hourly``)."""
