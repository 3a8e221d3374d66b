"""lakeweave.functions"""
