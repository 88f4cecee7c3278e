"""larkspan.streaming"""
