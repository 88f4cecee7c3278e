"""larkspan.plans"""
