"""larkspan.operators"""
