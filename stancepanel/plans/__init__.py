"""Registered queries and the stand-in inputs they run on."""
