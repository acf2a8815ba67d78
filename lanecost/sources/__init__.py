"""Source tables in, marts, exports and check results out."""
