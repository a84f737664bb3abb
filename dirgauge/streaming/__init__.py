"""Listings as streams."""

from dirgauge.streaming.ingest import finish_ingest, read_stream, stage_listing, stream_totals
