"""larkspan.sources"""
