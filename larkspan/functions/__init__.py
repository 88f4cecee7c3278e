"""larkspan.functions"""
