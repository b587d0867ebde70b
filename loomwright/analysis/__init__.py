"""Analyses: small result tables about a frame, or about a train and a test frame."""
