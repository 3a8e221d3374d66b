"""lakeweave.sources"""
